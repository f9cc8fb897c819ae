"""Audit of filters that remove the same documents: what each order of them removes, and each filter's fair share.

Each document is reduced to the set of filters that it fails, a bit mask. Per part
of the corpus the documents are counted by mask. With x_i the chance that filter i
is applied, the expected number of removed documents is the removal polynomial,
the sum over masks m of count(m) * (1 - product of (1 - x_i) over i in m). Its value
at a corner is what a set of filters removes, so differences of corners give every
step of every order. Its partial derivative in x_i, integrated along the diagonal,
is the Shapley share of filter i, in exact rationals.

Defined results: null text counts as empty; a null part is the empty string; a null
doc_id is no copy of another row and has no label; rows that repeat a doc_id are
counted each, and of equal texts all rows with the smallest doc_id are first;
labels that repeat a doc_id count as set if one of them is set; an empty table gives
no rows. Texts are compared by their SHA-256. Other columns are not read, so their
names may clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import shared_dir, stored

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def conditions(text: Column) -> dict[str, Column]:
    """Failing conditions of the filters that look at one text, by letter."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def removal_polynomial(counts: dict[int, int], k: int) -> dict[int, int]:
    """Coefficients by monomial, a bit mask of variables: inclusion and exclusion over the masks that contain it."""
    signed = {}
    for monomial in range(1, 1 << k):
        c = sum(n for mask, n in counts.items() if mask & monomial == monomial)
        if c:
            signed[monomial] = c if monomial.bit_count() % 2 else -c
    return signed


def corner(polynomial: dict[int, int], chosen: int) -> int:
    """The polynomial where the chosen variables are one and the others zero."""
    return sum(c for monomial, c in polynomial.items() if monomial & ~chosen == 0)


def share(polynomial: dict[int, int], i: int) -> Fraction:
    """The integral from 0 to 1 of the derivative in variable i with all variables equal."""
    derivative = ((monomial & ~(1 << i), c) for monomial, c in polynomial.items() if monomial >> i & 1)
    return sum((Fraction(c, rest.bit_count() + 1) for rest, c in derivative), Fraction(0))


def orders(part: str, counts: dict[str, dict[int, int]], letters: str) -> Iterator[tuple]:
    """A row of SCHEMA for each step of each order of the filters."""
    k = len(letters)
    total, every = sum(counts["n"].values()), (1 << k) - 1
    poly = {name: removal_polynomial(c, k) for name, c in counts.items()}
    at = {name: [corner(p, s) for s in range(1 << k)] for name, p in poly.items()}
    shares = [share(poly["n"], i) * math.factorial(k) for i in range(k)]
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            bit, after = 1 << i, before | 1 << i
            removed, good, toxic = (at[name][after] - at[name][before] for name in COUNTS)
            unique = at["n"][every] - at["n"][every & ~bit]
            yield part, "".join(letters[j] for j in order), step, total - at["n"][after], removed, at["n"][bit] - removed, unique, good, toxic, int(shares[i])
            before = after


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", fails: dict[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """Rows of SCHEMA; fails gives the conditions by letter, and the letter `copies` fails copies of a smaller doc_id's text.

    The rows that pass Python are the counts by mask, at most 2 ** filters a part.
    """
    shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = conditions(text) if fails is None else fails
    letters = "".join([*fails, copies])
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails.values())), F.lit(0))
    judged = stored(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask")), "judged")
    # A text's first row is joined on text and doc_id, so a text of very many copies is no hot key.
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = judged.join(firsts, ["digest", "doc_id"], "left")
    is_set = [F.max((F.col(name) == 1).cast("int")).alias(short) for name, short in (("quality", "good"), ("toxic", "toxic"))]
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    rows = marked.join(labels.groupBy("doc_id").agg(*is_set), "doc_id", "left").select("part", (F.col("mask") + F.when(copy, 1 << len(fails)).otherwise(0)).alias("mask"), "good", "toxic")
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        counts = {name: dict(zip(rows["mask"].tolist(), rows[name].tolist(), strict=True)) for name in COUNTS}
        return pd.DataFrame(orders(rows["part"].iloc[0], counts, letters), columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return counted.groupBy("part").applyInPandas(of_part, SCHEMA)
