"""Small tables with everything that operators must bear."""

from __future__ import annotations

import random
import re

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType()),
                   # names that operators use inside or for results
                   StructField("n", IntegerType()), StructField("node", StringType()), StructField("doc", StringType()),
                   StructField("size", StringType()), StructField("score", StringType()), StructField("shard", StringType())])
WORDS = "the of and to in that is for it with as was on be at by this had not are but from or have".split()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", ",", "."]) * rng.randint(0, 1)
                    + rng.choice(["", "a", "el", "ou", "ir"]) for _ in range(n))


def row(i, text, source="src0", lang="en"):
    return (i, text, lang, source, None if text is None else len(text), 7, "x", "y", "z", "s", "t")


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def awkward(seed=5):
    """Nulls, empties, blanks, one word, ties, copies, repeated rows, near
    copies, shared passages, shared lines and one very long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(25)]
    passage = prose(rng, 40)
    out = [row(i, t, f"src{i % 4}") for i, t in enumerate(base)]
    out += [row(30, None), row(31, ""), row(32, " \t\n "), row(33, "one"), row(34, "one"), row(35, "a b c"),
            row(36, "A  B\tc"), row(None, None, None, None), row(None, base[2]), row(None, "no id here at all")]
    out += [row(40 + k, base[3], None) for k in range(6)]
    out += [row(3, base[3]), row(3, base[3])]                        # repeated rows
    for k in range(8):                                               # near copies
        w = base[7].split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(row(50 + k, " ".join(w), "src1"))
    out += [row(60 + k, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 20)) for k in range(6)]
    out.append(row(70, prose(rng, 30000)))
    out.append(row(71, "The " * 400))
    out.append(row(72, "é" * 300 + " ß" * 60 + " 中文" * 40))
    rng.shuffle(out)
    return out
