import hashlib
import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = "row int, key string, bucket int, n int, hash int, shard string, size int, doc int, mark int, cut int, taken int, node int, sha int"
WORDS = "the quick brown fox jumps over lazy dogs while seven bright wizards quietly brew strong amber potion near old stone bridge".split()


def lowered(text):
    return (text or "").translate(LOWER)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def index_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def sentence(seed, n=40):
    """Words that look random and are the same in every run."""
    digest = hashlib.sha256(str(seed).encode()).digest() * (n // 16 + 1)
    return " ".join(WORDS[(digest[i] + i * digest[(i * 7) % 32]) % len(WORDS)] + str(digest[i] % 7) for i in range(n))


def messy_rows():
    base = sentence("base", 120)
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, base + " one more", "en", None), (4, None, None, None), (5, "", "en", "a"),
        (6, " \t\n", "en", "b"), (7, "word", "en", "b"), (8, "Word", None, "b"), (9, "two words", "fr", "b"), (10, "É ß ñ", "fr", "c"),
        (None, "no id at all but some words here", "en", "c"), (11, sentence("long", 5000), "en", "a"), (12, "!!! ??? ...", "en", "c"),
        (13, sentence("x"), "en", ""), (13, sentence("x"), "en", ""), (13, sentence("y"), "fr", "c"), (14, "a" * 3000, "en", "a"),
        (15, "Permission " + sentence("z"), "en", "\U0001F600"),
    ]
    rows += [(100 + i, base.replace("wizards", f"w{i}", 1) if i % 2 else base, "en", "hot") for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(d, t, la, s, len(t) if t is not None else None, *(None,) * 13) for d, t, la, s in messy_rows()]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}").repartition(5)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.filter("false")
