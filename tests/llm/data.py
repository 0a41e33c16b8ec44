"""A small table of hard documents: nulls, empty and long texts, copies, near copies, clashing columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, run int, row string, id long, rank int, block int, shard int"
PATTERN = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(own, every, seed):
    r = random.Random(seed)
    return [f"e{r.randrange(10**6)}" if k % every == every - 1 else w for k, w in enumerate(own)]


def texts():
    base, shared, other = words(120, 1), words(45, 2), words(900, 3)
    out = [
        None, "", "   \n\t ", "one", "two three four", "One two three four five.", " ".join(base), " ".join(base), " ".join(base), " ".join(base).upper(),
        " ".join(words(60, 4) + shared + words(70, 5)), " ".join(words(30, 6) + shared), "\n".join(shared), " ".join(other), " ".join(edited(other, 150, 7)), " ".join(edited(other, 100, 8)), " ".join(edited(other, 25, 9)),
        " ".join(["ha"] * 300), " ".join(["ho", "hum"] * 150), "Überraschung é ÀÉ naïve — ñandú 日本語のテキスト " * 6, "x" * 5000, " ".join(words(6000, 10, 5000)), "two three four", "a  b\tc\x0bd\re",
    ]
    return out + [" ".join(edited(base, 60, s)) for s in range(20, 32)]


def rows():
    made = [(k * 3 - 5, t, "en", f"s{k % 3}", 0 if t is None else len(t), "k", 1, 2, "r", 7, 1, 0, 0) for k, t in enumerate(texts())]
    return made


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def awkward(spark):
    """The same with repeated rows, a repeated id with another text, and null ids."""
    made = rows()
    more = [made[6], made[6], made[13], (made[7][0], "another text of the same id", *made[7][2:]), (None, made[6][1], *made[6][2:]), (None, None, *made[6][2:]), (None, "only here", *made[6][2:])]
    return spark.createDataFrame(made + more, SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
