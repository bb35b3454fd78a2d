"""Ordered-pattern screens of paper texts: gates, taxonomy, tags, tiers and ledgers.

Patterns are Java regular expressions without case; every screen is one projection, so it stays in the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import rules as R


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}")


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern's outermost level."""
    out, depth, at, k = [], 0, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[at:k])
            at = k + 1
        k += 1
    return [*out, pattern[at:]]


def required(alternative: str) -> str:
    """The longest plain text that every match of an alternative holds, in lower case."""
    runs, run, depth, k = [], "", 0, 0
    while k < len(alternative):
        c = alternative[k]
        if c in "?*{" and not depth:
            run = run[:-1]  # what it stands after may be missing
        if not depth and c.isascii() and (c.isalnum() or c in " &-"):
            run += c
        else:
            runs.append(run)
            run = ""
            depth += (c in "([") - (c in ")]")
            if c == "\\":
                k += 1
            elif c == "{":
                k = alternative.index("}", k)
        k += 1
    return max([*runs, run], key=len).lower()


def has_in(text: Column, low: Column, pattern: str, least: int = 3) -> Column:
    """``has`` for long tables of words; low: the text in lower case.

    The pattern is run only on texts that hold the plain text of one of its alternatives, which is a far cheaper search;
    alternatives without such text are a pattern of their own.
    """
    words = {a: required(a) for a in alternatives(pattern)}
    plain = sorted({w for w in words.values() if len(w) >= least})
    other = [a for a, w in words.items() if len(w) < least]
    hit = F.lit(False)
    for w in plain:
        hit = hit | F.contains(low, F.lit(w))
    hit = hit & text.rlike(f"(?i){pattern}")
    return hit | text.rlike(f"(?i){'|'.join(other)}") if other else hit


def has_any(text: Column, low: Column, pattern: str, least: int = 3) -> Column:
    """``has_in`` for patterns whose words are common: each alternative is run by itself, on the texts that hold its own plain text."""
    hit = F.lit(False)
    for a in sorted(alternatives(pattern), key=lambda a: len(required(a)) < least):
        word = required(a)
        here = text.rlike(f"(?i){a}")
        hit = hit | ((F.contains(low, F.lit(word)) & here) if len(word) >= least else here)
    return hit


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), f"(?i)({pattern})", 1)


def first_of(text: Column, table: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches."""
    out = None
    for label, pattern in table:
        hit = has(text, pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def all_of(text: Column, table: list[tuple[str, str]], limit: int | None = None) -> Column:
    """The labels of all patterns that match, in order, each once."""
    hits = F.array_distinct(F.filter(F.array(*[F.when(has(text, p), F.lit(label)) for label, p in table]), lambda x: x.isNotNull()))
    return hits if limit is None else F.slice(hits, 1, limit)


def practical(title: Column, abstract: Column) -> Column:
    """(ok, reason): not an essay, names a mechanism, data can be had, and the result is a position."""
    title, abstract = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    text = F.concat_ws(" ", title, abstract)
    no = lambda reason: F.struct(F.lit(False).alias("ok"), reason.alias("reason"))

    def judge(t: Column) -> Column:
        named = has_in(t["title"], t["low"], R.STRATEGY) | ((F.length(t["abstract"]) >= R.LEAST_ABSTRACT) & has_in(t["abstract"], t["low"], R.STRATEGY))
        return (
            F.when(has_in(t["text"], t["low"], R.ESSAY), no(F.lit(R.REASONS["essay"])))
            .when(~named, no(F.lit(R.REASONS["unnamed"])))
            .when(has_in(t["text"], t["low"], R.UNOBTAINABLE), no(F.concat(F.lit(R.REASONS["data"]), F.lower(found(t["text"], R.UNOBTAINABLE)), F.lit(")"))))
            .when(has_in(t["text"], t["low"], R.THEORY_ONLY), no(F.concat(F.lit(R.REASONS["theory"]), F.lower(found(t["text"], R.THEORY_ONLY)), F.lit(")"))))
            .otherwise(F.struct(F.lit(True).alias("ok"), F.lit(R.REASONS["runnable"]).alias("reason")))
        )

    # one evaluation of the text and its lower case for all patterns
    once = F.array(F.struct(title.alias("title"), abstract.alias("abstract"), text.alias("text"), F.lower(text).alias("low")))
    return F.transform(once, judge)[0]


def testability(text: Column) -> Column:
    return F.when(has(text, R.NEEDS_MORE), "blocked").when(has(text, R.TESTABLE), "queued").otherwise("triage")


def tags(text: Column) -> Column:
    hits = all_of(text, R.TAGS, 3)
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(R.DEFAULT_TAG)))


NARROW = [(f"{a}|{t}", p) for a, t, p in R.TASKS if t not in R.BROAD]
WIDE = [(f"{a}|{t}", p) for a, t, p in R.TASKS if t in R.BROAD]


def taxonomy(text: Column) -> Column:
    """(area, task): the first narrow task over all areas, then the first broad one."""
    both = F.split(first_of(text, NARROW + WIDE, "|".join(R.CATCH_ALL)), r"\|")
    return F.struct(both[0].alias("area"), both[1].alias("task"))


def task_tags(text: Column, limit: int = 4) -> Column:
    return all_of(text, [(t, p) for _, t, p in R.TASKS], limit)


def abstract_screen(title: Column, abstract: Column) -> Column:
    """(verdict, why): real data is read; theory and simulation are skipped; the silent are read."""
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    row = lambda v, why: F.struct(F.lit(v).alias("verdict"), why.alias("why"))

    def judge(t: Column) -> Column:
        theory, synth = has_any(t["text"], t["low"], R.THEORY), has_any(t["text"], t["low"], R.SYNTHETIC)
        what = lambda p: F.substring(F.trim(found(t["text"], p)), 1, 28)
        return (
            F.when(has_any(t["text"], t["low"], R.EMPIRICAL), row("read", F.lit("names real data or an out-of-sample test")))
            .when(theory, F.when(synth, row("skip", F.concat(F.lit("theory and simulation only ("), what(R.THEORY), F.lit(")")))).otherwise(row("skip", F.concat(F.lit("analytical contribution only ("), what(R.THEORY), F.lit(")")))))
            .when(synth, row("skip", F.concat(F.lit("simulation only ("), what(R.SYNTHETIC), F.lit(")"))))
            .otherwise(row("read", F.lit("abstract is not explicit, resolve by reading")))
        )

    # one evaluation of the text and its lower case for all patterns
    return F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), judge)[0]


def gap(reason: Column) -> Column:
    return first_of(reason, R.GAPS, "other")


def effort(method: Column, data_needed: Column) -> Column:
    """(tier, why) of a paper by what has to be trained, joined or fitted."""
    text = F.concat_ws(" ", F.coalesce(method, F.lit("")), F.coalesce(F.array_join(data_needed, " "), F.lit("")))
    sources = F.coalesce(F.size(data_needed), F.lit(0))
    universe = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, f"(?i){R.BIG_UNIVERSE}", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    row = lambda t, why: F.struct(F.lit(t).alias("tier"), why.alias("why"))
    return (
        F.when(has(text, R.TRAINED), row("L", F.lit("a model has to be trained, so results move with the seed")))
        .when((universe >= 100) | (sources >= 4), row("M", F.when(universe > 0, F.concat(universe, F.lit(" names"))).otherwise(F.concat(sources, F.lit(" separate sources")))))
        .when(has(text, R.FITTED), row("M", F.lit("an estimator has to be fitted and checked")))
        .otherwise(row("S", F.lit("closed-form on a small universe")))
    )


def numeracy(targets: Column) -> Column:
    """Digits in all target strings."""
    return F.coalesce(F.aggregate(targets, F.lit(0), lambda a, x: a + F.length(F.regexp_replace(x, "[^0-9]", ""))), F.lit(0))


def worth_building(confidence: Column, digits: Column) -> Column:
    return F.coalesce((confidence >= 0.8) & (digits >= 40), F.lit(False))


def contradictions(reason: Column, needs: Column | None = None) -> Column:
    """Free sources that a rejection takes to be out of reach."""
    text = F.concat_ws(" ", F.coalesce(reason, F.lit("")), *([F.coalesce(F.array_join(needs, " "), F.lit(""))] if needs is not None else []))
    claims = ~has(text, R.PAID) & has(text, R.UNAVAILABLE) & ~has(text, R.CONCEDED)
    return F.when(claims, all_of(text, R.FREE)).otherwise(F.array().cast("array<string>"))


def coverage_class(token: Column, covered: list[str], missing: list[str]) -> Column:
    """covered, not_covered or unknown: exact names first, then a substring either way."""
    t = F.lower(F.trim(token))
    either = lambda names: F.exists(F.array(*map(F.lit, names)), lambda x: F.contains(t, x) | F.contains(x, t))
    return F.when(t.isin(covered), "covered").when(t.isin(missing), "not_covered").when(either(missing), "not_covered").when(either(covered), "covered").otherwise("unknown")


def paper_coverage(tokens: DataFrame, by: str) -> DataFrame:
    """blocked if any token is not covered, full if all are, else partial, or unknown if none is known."""
    c = F.col("coverage")
    return tokens.groupBy(by).agg(F.when(F.bool_or(c == "not_covered"), "blocked").when(F.every(c == "covered"), "full").when(F.bool_or(c == "covered"), "partial").otherwise("unknown").alias("coverage"))


def base_id(paper_id: Column) -> Column:
    """An identifier without its version."""
    return F.regexp_replace(F.trim(F.coalesce(paper_id, F.lit(""))), "v[0-9]+$", "")


def title_key(title: Column, length: int | None = None) -> Column:
    """Lower case, runs of other characters than letters and digits as one space."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))
    return key if length is None else F.substring(key, 1, length)


def dedupe(papers: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return papers.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def ingest(new: DataFrame, known: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New records whose key is not known yet, each key once, the first by ``order``."""
    return dedupe(new.join(known.select(*keys).distinct(), keys, "left_anti"), F.struct(*keys), F.col(order))


def ingest_counts(new: DataFrame, known: DataFrame, keys: list[str], order: str, by: str = "source") -> DataFrame:
    """(by, new, dup, total): what ``ingest`` takes of each source and what it passes over."""
    taken = ingest(new, known, keys, order).groupBy(by).agg(F.count(F.lit(1)).alias("new"))
    total = new.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    fresh = F.coalesce(F.col("new"), F.lit(0).cast("long"))
    both = total.join(taken.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left")
    return both.select(by, fresh.alias("new"), (F.col("total") - fresh).alias("dup"), "total")


def gated(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """(base, title, abstract, state) of what a listing (id, title, abstract, published) has to offer.

    Of the versions of a paper the newest counts; papers dropped in the ledger (base, verdict) are not read again; the
    practical gate decides, and testability names the state.
    """
    newest = Window.partitionBy("base").orderBy(F.desc("published"), F.desc("id"))
    rows = listing.withColumn("base", F.regexp_replace("id", "v[0-9]+$", "")).join(ledger.filter("verdict = 'drop'").select("base"), "base", "left_anti")
    rows = rows.withColumn("__r", F.row_number().over(newest)).filter("__r = 1").filter(practical(F.col("title"), F.col("abstract"))["ok"])
    return rows.select("base", "title", "abstract", testability(F.concat_ws(" ", "title", "abstract")).alias("state"))


def idea(abstract: Column, limit: int = 200) -> Column:
    """Leading sentences up to a length, without a boilerplate opener, cut at a word."""
    body = F.regexp_replace(F.coalesce(abstract, F.lit("")), r"(?i)^\s*(abstract|this (paper|study|article)|in this (paper|study|article),?( we)?)[:.]?\s*", "")
    parts = F.split(F.trim(body), r"(?<=[.!?])\s+")
    taken = F.aggregate(parts, F.lit(""), lambda a, x: F.when((a == "") | (F.length(a) + 1 + F.length(x) <= limit), F.trim(F.concat_ws(" ", a, x))).otherwise(a))
    cut = F.regexp_extract(taken, rf"(?s)^(.{{0,{limit}}})(\s|$)", 1)
    return F.when(F.length(taken) <= limit, taken).otherwise(F.concat(cut, F.lit("…")))


def recall_of_screen(screened: DataFrame) -> DataFrame:
    """Recall on kept papers and share of reads saved, of (verdict, label)."""
    keeps, skips = F.col("label") == "keep", F.col("verdict") == "skip"
    return screened.agg(F.count_if(keeps).alias("keeps"), F.count_if(keeps & ~skips).alias("kept_and_read"), F.count_if(~keeps).alias("drops"), F.count_if(~keeps & skips).alias("drops_skipped"), F.round(F.count_if(keeps & ~skips) / F.count_if(keeps), 6).alias("recall"), F.round(F.count_if(skips) / F.count(F.lit(1)), 6).alias("saved"))


def confusion(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, f1) of (expected, actual)."""
    long = pairs.select(F.explode(F.array(*map(F.lit, classes))).alias("class"), "expected", "actual")
    e, a = F.col("expected") == F.col("class"), F.col("actual") == F.col("class")
    row = long.groupBy("class").agg(F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return row.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def asymmetric_loss(fn: Column, fp: Column, score: Column | None = None) -> Column:
    """Missed papers cost five, false alarms one; a score adds twice its distance from 0.6, a score of 0 counting as 0.6."""
    loss = 5 * fn + fp
    return loss if score is None else loss + F.when(score.isNull(), 0.0).otherwise(2 * F.abs(F.when(score == 0, F.lit(0.6)).otherwise(score) - 0.6))
