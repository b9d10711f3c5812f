"""Small documents with the awkward cases, and brute-force helpers."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def rows(spark, texts, first=0):
    return [(i + first, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark, texts, schema=DOC_SCHEMA):
    return spark.createDataFrame(rows(spark, texts), schema)


def save(spark, tmp_path, texts, name="documents", schema=DOC_SCHEMA):
    """A folder with the table, as the registered queries read it."""
    documents(spark, texts, schema).coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
