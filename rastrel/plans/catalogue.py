"""The catalogue of queries: one entry per operator, with equivalent SQL where SQL can express it."""

from rastrel.plans import features, pixels, scenes, vectors  # noqa: F401  (they register their queries)
from rastrel.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "p1_ndsm_strata"
