"""Keyed state with timeouts: watched sources that fall quiet, polls that slow down, jobs that end once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenshelf.functions.workers import ship
from lumenshelf.streaming.events import FIRST_POLL_S, LAST_POLL_S, MANY_PATHS

QUIET_MS = 600


def watched(changes: DataFrame, quiet_ms: int = QUIET_MS, many: int = MANY_PATHS) -> DataFrame:
    """A stream of changes (source_id, path) as one row per burst: source_id, changes, paths, rescan.

    Changes of a source are gathered until it has been quiet for ``quiet_ms``. Then one row tells what to look at:
    its distinct paths, or that the whole source is to be listed again, if more than ``many`` changed or
    one change named no path. So the state of a source holds ``many`` paths at most.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        changes, paths, whole = state.get if state.exists else (0, [], False)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"source_id": [key[0]], "changes": [changes], "paths": [sorted(paths)], "rescan": [whole]})
            return
        seen = set(paths)
        for frame in frames:
            changes += len(frame)
            named = frame["path"].dropna()
            seen |= set(named)
            whole = whole or len(named) < len(frame) or len(seen) > many
        state.update((changes, [] if whole else sorted(seen), whole))
        state.setTimeoutDuration(quiet_ms)

    ship(changes.sparkSession)
    rows = changes.select("source_id", "path").groupBy("source_id")
    return rows.applyInPandasWithState(step, "source_id string, changes long, paths array<string>, rescan boolean", "changes long, paths array<string>, whole boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def paced(answers: DataFrame, first: int = FIRST_POLL_S, last: int = LAST_POLL_S) -> DataFrame:
    """A stream of poll answers (source_id, poll, changed) as the seconds to wait after each batch: source_id, poll, seconds.

    The pace of a source starts at ``first``, doubles with each poll that found nothing, up to ``last``, and
    starts again after a change. Polls are numbered: an answer that comes late or twice does not move the pace again.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        poll, seconds = state.get if state.exists else (0, first)
        before = poll
        answers = pd.concat(list(frames)).sort_values("poll")
        for number, changed in zip(answers["poll"].tolist(), answers["changed"].tolist()):
            if number > poll:
                poll, seconds = number, first if changed else min(seconds * 2, last)
        if poll > before:
            state.update((poll, seconds))
            yield pd.DataFrame({"source_id": [key[0]], "poll": [poll], "seconds": [seconds]})

    ship(answers.sparkSession)
    rows = answers.select("source_id", "poll", "changed").groupBy("source_id")
    return rows.applyInPandasWithState(step, "source_id string, poll long, seconds long", "poll long, seconds long", "update", GroupStateTimeout.NoTimeout)


def jobs_followed(updates: DataFrame) -> DataFrame:
    """A stream of job updates (job, version, state, done, total) as each job's state whenever it changes.

    Updates may come late, twice or out of order: the latest version counts, but a cancellation beats a later done.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = state.get if state.exists else None
        version, name, done, total, cancelled = told or (-1, "", 0, 0, False)
        for frame in frames:
            for v, s, d, t in zip(*[frame[c].tolist() for c in ("version", "state", "done", "total")]):
                cancelled = cancelled or s == "cancelled"
                if v > version:
                    version, name, done, total = v, s, d, t
        now = (version, name, done, total, cancelled)
        if now != told:
            state.update(now)
            progress = [round(done / total, 6) if total else None]
            yield pd.DataFrame({"job": [key[0]], "version": [version], "state": ["cancelled" if cancelled else name], "done": [done], "progress": pd.Series(progress, dtype="float64")})

    ship(updates.sparkSession)
    rows = updates.select("job", "version", "state", "done", "total").groupBy("job")
    return rows.applyInPandasWithState(step, "job long, version long, state string, done long, progress double", "version long, state string, done long, total long, cancelled boolean", "update", GroupStateTimeout.NoTimeout)
