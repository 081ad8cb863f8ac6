"""Tables that hold every odd case: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
#: One word of a million letters, and forty thousand lines.
ONE_WORD, MANY_LINES = "q" * 1_000_000, "\n".join(f"line {i} of it {i % 7}" for i in range(40_000))


def rows():
    same = "the same line here\nanother line of the same document " + " ".join(f"w{i}" for i in range(60))
    out = [(i, f"{same}\nown{i}" if i < 12 else f"unlike {i} " + " ".join(f"u{i}x{k}" for k in range(70)), "en", ["a", "b", "ü", None][i % 4], 5) for i in range(30)]
    out += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \t\n \x0b", "en", "a", 4), (None, "no id here", "en", "a", 10), (None, None, None, None, None)]
    out += [(103, LONG, "en", "b", len(LONG)), (104, "twice told", "en", "b", 10), (104, "twice told", "en", "b", 10), (104, "told otherwise", "de", "a", 1)]
    out += [(105, "naïve ÀÉ \U0001f600 #tag *** $5 <b> & | %\n\n\nnaïve\nnaïve", "fr", "ü", 1), (106, "<|endoftext|> in it 's't 12 ²³ \x1c \x85 end  ", "en", "a", 1)]
    out += [(107, ONE_WORD, "en", "a", 1_000_000), (108, MANY_LINES, "en", "b", 1)]
    return out


def docs(spark, extra=()):
    return spark.createDataFrame([*rows(), *extra], SCHEMA)


def clashing(df, *names):
    """df with further columns of these names, whose values make no sense."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(f"clash {n}") for n in names if n not in df.columns})


def words(text):
    return WORD.findall(text or "")
