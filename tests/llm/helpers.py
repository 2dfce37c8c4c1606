"""Small document tables with everything that operators must bear."""

from __future__ import annotations

import random

WORDS = [f"w{i}" for i in range(60)]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def some_texts(seed: int = 1, n: int = 60) -> list[str | None]:
    """Texts with copies, near copies, shared passages, repeats, blanks and one long text."""
    r = random.Random(seed)
    prose = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    passage = prose(70)
    out: list[str | None] = [None, "", "   \n\t", "a", "A", "one two", "Ärger über Maß 😀", "x" * 5000, "the " * 120]
    for i in range(n):
        text = prose(r.randint(1, 200))
        if i % 4 == 0:
            words = text.split()
            at = r.randrange(len(words))
            text = " ".join([*words[:at], passage, *words[at:]])
        if i % 5 == 0:
            text = text.replace(" ", "\n", 8)
        out.append(text)
        if i % 3 == 0:
            out.append(text)
        if i % 7 == 0:
            out.append(text.replace(" ", "  ", 3).upper() if i % 2 else text + " extra")
    out.append(prose(4000))
    return out


def some_docs(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows of ``documents``: null ids, null sources, repeated rows."""
    texts = some_texts(seed, n)
    rows = [(i * 3 % 1009, t, [None, "en", "de"][i % 3], [None, "a", "b", "", "c"][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "no id here " * 30, None, None, 5), rows[12], rows[13], rows[12]]
    random.Random(seed).shuffle(rows)
    return rows


def frame(spark, rows, schema=DOCS, parts=5):
    return spark.createDataFrame(rows, schema).repartition(parts)


def clashing(df):
    """The same rows with more columns, named like those that operators make."""
    from pyspark.sql import functions as F

    names = ["fp", "key", "row", "doc", "size", "_norm", "_digest", "_n", "rank", "kept", "keep_id", "component_id", "n", "score", "target", "_size", "_key", "host", "pos"]
    return df.select("*", *[F.lit(1).alias(c) for c in names])


def awkward(df):
    """The same rows with columns of the names that fits and dedups make, in any case."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in ("_sha", "_gone", "_nth", "_row", "_key", "_y", "y", "_id", "_PART", "_again", "_key_gone", "_turn")])
