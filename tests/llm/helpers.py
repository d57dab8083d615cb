"""Small awkward documents that every operator must take."""

import re

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators might be tempted to use for themselves
    + [T.StructField(n, T.StringType()) for n in ("score", "n", "rep", "cluster", "mix_tokens", "key", "grp")]
)
PROSE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf into the dark wood "
LONG = " ".join(f"word{i % 997} und{i % 13}" for i in range(20_000))
TEXTS = [
    (1, PROSE * 4), (2, PROSE * 4), (3, (PROSE * 4).upper()), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one two"), (9, LONG), (10, LONG + " end"),
    (11, "mail me at jo.doe@example.com or +1 (555) 123-4567 from 10.0.0.1 with 4111 1111 1111 1111"), (None, "nobody " * 20), (12, "12345 67890"), (13, "der die das und nicht ein eine der haus baum wald " * 3),
    (13, "der die das und nicht ein eine der haus baum wald " * 3), (14, "%%% ### $$$ " * 30 + "a b"), (15, "a\nb\na\n\n c \na"), (16, "日本語 テキスト かな"), (17, "x\u00a0y\u2003z <|endoftext|> \x1c q"),
]
NAN = [None] * 7


def rows(texts=TEXTS):
    langs = {None: None, 4: None, 13: "de", 16: "ja"}
    return [(i, t, langs.get(i, "en"), None if i == 7 else f"s{(i or 0) % 2}", None if t is None else len(t), *NAN) for i, t in texts]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts), SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
