import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, id string, size int"


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgst") for _ in range(rng.randint(1, 7))) for _ in range(n))


def make_rows():
    """Documents with nulls, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(3)
    rows = []
    base = [_words(rng, rng.randint(1, 120)) for _ in range(60)]
    for i, t in enumerate(base):
        rows.append((i, t, "xy"[i % 2], f"s{i % 4}"))
    near = base[5].split() + _words(rng, 200).split()
    for k in range(12):  # near copies of one text
        w = list(near)
        w[10 + 15 * k] = "changed"
        rows.append((100 + k, " ".join(w), "x", "s1"))
    for k in range(15):  # exact copies, one in capitals
        rows.append((200 + k, base[7].upper() if k == 3 else base[7], "y", "s1"))
    rows += [(300, None, None, None), (301, "", "x", "s2"), (302, " \n\t ", "x", None), (303, _words(rng, 30_000), "x", "s3")]
    rows += [(304, "the same line\nthe same line\n" * 20, "y", "s3"), (305, "ÄÖÜ é 😀 ▁ token = \"04dbebab91ab85687d33eeaa\"", "y", "s3")]
    rows += [(306, "one <|endoftext|> two<|startoftext|>three <|ENDOFTEXT|>", "x", "s3")]
    rows += [rows[0], rows[0], (None, "a row without an id", "x", "s0"), (None, None, "x", "s0")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The documents, with extra columns whose names operators use inside."""
    full = [(i, t, lang, s, len(t or ""), "h", "k", "own", 1) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
