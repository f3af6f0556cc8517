"""Licence scan: lines and runs of words against licence templates, by Dice coefficient over word bigrams. SQL functions only.

Licences differ from each other by single words: a version, a variant, a condition. So each template has a key, the bigrams
that tell it from its relatives; without all of them no score is enough, and a notice of a licence that no template names
is not taken for a relative of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.licence_texts import templates

MIN_DICE = 0.8

TEMPLATES = tuple((licence, text) for licence, text, _ in templates())
KEYS = tuple(key for *_, key in templates())


def words_of(text: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(size: int, least: float = MIN_DICE) -> tuple[float, float]:
    """Sizes of a set whose Dice coefficient with a set of ``size`` can reach ``least``: 2 min / (a + b) >= least."""
    return size * least / (2 - least), size * (2 - least) / least


def telling(keys: tuple[str, ...] = KEYS) -> list[list[str]]:
    """For each template the bigrams of its key, of each part on its own."""
    return [list(dict.fromkeys(b for part in key.split("|") for b in bigrams_of(part))) for key in keys]


def needles(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = MIN_DICE) -> list[str]:
    """Bigrams of which a text holds one at least, wherever ``least`` is reached.

    A set that reaches ``least`` has n * least / (2 - least) or more of a template's n bigrams, so of any bigrams more
    in number than the rest it has one. The longest are taken, since they are rare.
    """
    out: list[str] = []
    for _, text in templates:
        mine = sorted(bigrams_of(text), key=lambda b: (-len(b), b))
        out += mine[: len(mine) - _ceil(bounds(len(mine), least)[0]) + 1]
    return list(dict.fromkeys(out))


def _ceil(x: float) -> int:
    return math.ceil(x - 1e-9)


def _floor(x: float) -> int:
    return math.floor(x + 1e-9)


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class _Given:
    """The templates as a few literals, folded when a query is planned: expressions do not grow with their number.

    A template is an index into them; its bigrams are cut out of one string where they are wanted."""

    def __init__(self, templates: tuple[tuple[str, str], ...], keys: tuple[str, ...], least: float):
        mine, must = [bigrams_of(text) for _, text in templates], telling(keys)
        spans = [bounds(len(b), least) for b in mine]
        self.low, self.high = min(s[0] for s in spans), max(s[1] for s in spans)
        self.known = sorted({b for bag in mine for b in bag})

        def numbers(values: list, kind: str) -> Column:
            return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")

        def strings(values: list[str]) -> Column:
            return F.split(F.lit(";".join(values)), ";")

        self.every = numbers(list(range(len(templates))), "int")
        self._columns = {
            "size": numbers([len(b) for b in mine], "int"), "keyed": numbers([len(b) for b in must], "int"),
            "low": numbers([s[0] for s in spans], "double"), "high": numbers([s[1] for s in spans], "double"),
            "need": numbers([_ceil(s[0]) for s in spans], "int"), "most": numbers([_floor(s[1]) for s in spans], "int"),
            "licence": strings([name for name, _ in templates]), "mine": strings([",".join(b) for b in mine]),
            "must": strings([",".join(b) for b in must]),
        }

    def of(self, index: Column, name: str) -> Column:
        value = F.get(self._columns[name], index)
        return F.split(value, ",") if name in ("mine", "must") else value


def _score(bag: Column, given: _Given, t: Column) -> Column:
    """Dice coefficient of a set of bigrams with a template's, 0 without its whole key."""
    held = F.size(F.array_intersect(bag, given.of(t, "must"))) == given.of(t, "keyed")
    same = F.size(F.array_intersect(bag, given.of(t, "mine")))
    return F.when(held, 2.0 * same / (F.size(bag) + given.of(t, "size"))).otherwise(0.0)


def _line_match(words: Column, line: Column, given: _Given, least: float) -> Column:
    """The best template of one line, null if none reaches ``least``."""

    def best(pairs: Column) -> Column:
        # Size bounds first: only templates that the sizes allow are intersected.
        fit = F.filter(given.every, lambda t: F.size(pairs).between(given.of(t, "low"), given.of(t, "high")))
        found = F.transform(
            fit,
            lambda t: F.struct(
                _score(pairs, given, t).alias("score"), (-t).alias("place"), line.alias("line"), line.alias("last"),
                given.of(t, "licence").alias("licence"),
            ),
        )
        top = _let(F.array_max(found), lambda x: F.when(x["score"] >= least, x))
        return F.when(F.size(pairs).between(given.low, given.high) & F.exists(pairs, lambda p: F.array_contains(F.col("seen"), p)), top)

    # A set of n bigrams needs n + 1 words; repeated words can make a long line's set small.
    return F.when(F.size(words) > given.low, _let(F.array_distinct(_pairs(words)), best))


def _windows(given: _Given, t: Column, least: float) -> Column:
    """Of the columns ``pairs`` and ``hits``: the best window from each place where one of the template's bigrams stands.

    A window begins and ends with bigrams of the template, since others at its ends only lower the score. Size bounds
    first: bigrams of the template too few, or too far apart, make no window.
    """
    need, most = given.of(t, "need"), given.of(t, "most")

    def from_place(own: Column) -> Column:
        def best(start: Column, x: Column) -> Column:
            def scored(end: Column) -> Column:
                length = end["at"] - start["at"] + 1
                bag = F.array_distinct(F.slice("pairs", start["at"] + 1, length))
                return F.struct(
                    _let(bag, lambda b: _score(b, given, t)).alias("score"), (-length).alias("place"), start["at"].alias("first"),
                    end["at"].alias("end"),
                )

            ends = F.filter(F.slice(own, x + need, most - need + 1), lambda e: e["at"] - start["at"] < most)
            return F.array_max(F.transform(ends, scored))

        found = F.filter(F.transform(own, best), lambda w: w.isNotNull() & (w["score"] >= least))
        return F.when(F.size(own) >= need, found)

    def named(w: Column) -> Column:
        return F.struct(
            w["first"].alias("first"), w["end"].alias("end"), w["score"].alias("score"), (-t).alias("place"),
            F.element_at("line_of", w["first"] + 1).alias("line"), F.element_at("line_of", w["end"] + 2).alias("last"),
            given.of(t, "licence").alias("licence"),
        )

    def among(mine: Column) -> Column:
        return F.filter("hits", lambda h: F.array_contains(mine, h["pair"]))

    # Fewer hits in the whole text than a template needs make no window of it.
    found = F.transform(_let(_let(given.of(t, "mine"), among), from_place), named)
    return F.when(F.size("hits") >= need, found)


def notices(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, keys: tuple[str, ...] = KEYS, least: float = MIN_DICE
) -> DataFrame:
    """``(doc_id, line, last_line, template, licence, score)``: whole lines, and runs of words inside a line or across
    line ends, that reach ``least`` and hold their template's key, each with its best template. Runs that share a word with a line found as a whole
    are part of it; of runs that overlap the best one counts, the earlier of equals.
    """
    given = _Given(templates, keys, least)
    sought = needles(templates, least)
    known = F.split(F.lit(",".join(given.known)), ",")
    # A text that holds a bigram holds its longer word: one look at the words spares most texts the search for bigrams.
    rare = sorted({max(b.split(" "), key=len) for b in sought})

    def holds(norm: Column) -> Column:
        return reduce(Column.__or__, (norm.contains(b) for b in sought))

    def may_hold(norm: Column) -> Column:
        return F.when(F.arrays_overlap(F.split(norm, " "), F.lit(rare)), holds(norm)).otherwise(False)

    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).where(F.exists(F.array(_norm(F.col("text"))), may_hold))
    words = F.transform(F.split("text", "\n"), lambda said: F.filter(F.split(_norm(said), " "), lambda w: w != ""))
    rows = rows.select("doc_id", words.alias("lines"))
    line_of = F.flatten(F.transform("lines", lambda ws, k: F.transform(ws, lambda w: k)))
    rows = rows.select("doc_id", "lines", line_of.alias("line_of"), F.flatten("lines").alias("words"))
    rows = rows.where(F.size("words") > 1).select("doc_id", "lines", "line_of", _pairs(F.col("words")).alias("pairs"))
    seen = F.array_intersect(F.array_distinct("pairs"), known)
    rows = rows.select("*", seen.alias("seen"))
    hits = F.transform("pairs", lambda p, at: F.when(F.array_contains(F.col("seen"), p), F.struct(at.alias("at"), p.alias("pair"))))
    rows = rows.select("*", F.filter(hits, lambda h: h.isNotNull()).alias("hits"))
    whole = F.filter(F.transform("lines", lambda ws, k: _line_match(ws, k, given, least)), lambda m: m.isNotNull())
    runs = F.flatten(F.filter(F.transform(given.every, lambda t: _windows(given, t, least)), lambda r: r.isNotNull()))
    rows = rows.select("*", whole.alias("whole"))
    apart = F.filter(runs, lambda w: ~F.exists("whole", lambda m: m["line"].between(w["line"], w["last"])))
    rows = rows.select("doc_id", "whole", F.array_sort(apart).alias("runs"))

    def sweep(kept: Column, w: Column) -> Column:
        # In order of their first words: a run that shares a word with the last one kept takes its place if better.
        def against(last: Column) -> Column:
            better = (w["score"] > last["score"]) | ((w["score"] == last["score"]) & (w["first"] == last["first"]) & (w["place"] > last["place"]))
            instead = F.when(better, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(w))).otherwise(kept)
            return F.when(w["first"] > last["end"] + 1, F.concat(kept, F.array(w))).otherwise(instead)

        return F.when(F.size(kept) == 0, F.array(w)).otherwise(_let(F.element_at(kept, -1), against))

    kept = F.aggregate("runs", F.filter("runs", lambda w: F.lit(False)), sweep)
    kept = F.transform(kept, lambda w: F.struct(*(w[c].alias(c) for c in ("score", "place", "line", "last", "licence"))))
    found = rows.select("doc_id", F.explode(F.concat("whole", kept)).alias("n"))
    return found.select(
        "doc_id", F.col("n.line").alias("line"), F.col("n.last").alias("last_line"), (-F.col("n.place")).alias("template"),
        "n.licence", "n.score",
    )


def scan(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, keys: tuple[str, ...] = KEYS, least: float = MIN_DICE
) -> DataFrame:
    """``(doc_id, n_lines, licence, score)`` for each licence of each doc_id, with its number of notices and best score.

    A notice is a line or a run of words (`notices`), at any place in a text of any length. Null and empty texts have
    none; rows that repeat a doc_id count together; rows with a null doc_id count as one id. Other columns are not read.
    An empty table gives an empty result. The SQL twin names only the best licence of a doc_id and reads whole lines:
    the two agree on tables, such as the given ones, whose documents have one licence and no other notices.
    """
    found = notices(docs, templates, keys, least).groupBy(F.col("doc_id").cast("long").alias("doc_id"), "licence")
    found = found.agg(F.count("*").alias("n_lines"), F.max("score").alias("score"))
    return found.select("doc_id", "n_lines", "licence", F.round("score", 9).alias("score"))
