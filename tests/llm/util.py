"""Small tables and plain forms of the operators, to hold results against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0, extra=False):
    rows = [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # columns with names that operators use inside
        for name in ("score", "start", "shard", "class_key", "_group", "held", "n", "bucket"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n=200, vocabulary=500):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


ODD = [None, "", " ", "\n\t ", "a", "A b", "é\x1c ü　x  y\r\n", "same same same same same same", "x" * 50_000, "word " * 20_000, "<|endoftext|> <|startoftext|> it's I'LL 12 345!!", "日本語 テキスト 😀", "same same same same same same"]
