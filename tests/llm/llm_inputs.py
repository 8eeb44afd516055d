"""Small inputs with the awkward rows that every operator must take."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while the cat sleeps near the warm old stove in the kitchen"

AWKWARD = [
    (1, PROSE, "en", "a", 5),
    (2, PROSE, "en", "a", 5),
    (2, PROSE, "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "de", "", 0),
    (5, " \t\n ", "de", None, 3),
    (6, LONG, "en", "b", None),
    (None, "ein haus am see und ein boot", "de", "b", 1),
    (None, None, None, None, None),
    (7, PROSE + " extra", "en", None, 9),
    (8, "1234 5678 !!", "xx", "a", 1),
    (9, "\U0001f600 émigré ÀÉ", None, "a", 2),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, SCHEMA)


CLASHING = (
    "score n sid key rep a b u v m h r part edge copy row_id row_hash _id _hash _rank _size _at _position _shard slot shard "
    "component component_id node ids start length offset bucket fingerprint toxic item_id seeds site template html_ k c size"
).split()


def with_clashes(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING if c not in df.columns})


def rows(df, *columns):
    """Rows as sorted tuples, nulls included."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
