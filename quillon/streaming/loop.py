"""The loop over papers: poll, triage the queue, replicate what is tradable, log; a step that fails does not stop the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import screens
from quillon.plans.shared import staged


@dataclass
class State:
    """What a round leaves: papers (id, external_id, inserted, status, ...), results of replications, counts and errors."""

    papers: DataFrame
    results: DataFrame | None
    polled: int = 0
    triaged: int = 0
    tradable: int = 0
    replicated: int = 0
    errors: list[str] = field(default_factory=list)

    def counts(self) -> tuple[int, int, int, int, int]:
        return self.polled, self.triaged, self.tradable, self.replicated, len(self.errors)


@dataclass
class Loop:
    """judge: the status of a pending paper, ``tradable`` or another; replicate: papers to results (external_id, ...).

    A round triages at most ``triage_limit`` papers, the oldest first, and replicates at most ``replicate_limit`` tradable
    ones, the newest first, that have no result yet.
    """

    judge: Column
    replicate: Callable[[DataFrame], DataFrame]
    triage_limit: int = 20
    replicate_limit: int = 5

    def round(self, before: State, feed: DataFrame | None = None) -> State:
        """One round; feed: new papers without status, or none to skip polling."""
        now = State(before.papers, before.results)
        for name, step in (("poll", lambda: self._poll(now, feed)), ("triage", lambda: self._triage(now)), ("replicate", lambda: self._replicate(now))):
            try:
                step()
            except Exception as e:  # noqa: BLE001  a round reports what failed and goes on
                now.errors.append(f"{name}: {type(e).__name__}: {e}")
        return now

    def _poll(self, now: State, feed: DataFrame | None) -> None:
        if feed is None:
            return
        new = staged(screens.ingest(feed, now.papers, ["external_id"], "id").withColumn("status", F.lit("pending")), "polled")
        now.polled = new.count()
        now.papers = staged(now.papers.unionByName(new, allowMissingColumns=True), "papers")

    def _triage(self, now: State) -> None:
        due = now.papers.filter("status = 'pending'").orderBy("inserted", "id").limit(self.triage_limit)
        judged = staged(due.select("id", self.judge.alias("verdict")), "judged")  # at most triage_limit rows
        row = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "tradable").alias("up")).first()
        both = now.papers.join(F.broadcast(judged), "id", "left").withColumn("status", F.coalesce("verdict", "status")).drop("verdict")
        now.papers, now.triaged, now.tradable = staged(both, "papers"), row["n"], row["up"]

    def _replicate(self, now: State) -> None:
        newest = now.papers.filter("status = 'tradable'").orderBy(F.desc("id")).limit(self.replicate_limit)
        due = newest if now.results is None else newest.join(now.results.select("external_id"), "external_id", "left_anti")
        done = staged(self.replicate(due), "replicated")
        now.replicated = done.count()
        now.results = done if now.results is None else staged(now.results.unionByName(done), "results")
