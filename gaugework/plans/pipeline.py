"""A queue of cleaning steps, run in order on a DataFrame, with a log.

Steps see the table as the steps before them left it.  Row ids refer to the
original table and stay valid throughout, because the id column is carried
along and never renumbered.

A statistic that follows a shuffle reads a table written after it, so the
number of jobs grows with the steps and not with their square.  The log's counts
are observed metrics on a second plan of the same steps: one pass for all of
them, and one small join for each step that caps or clears outliers.  The table
handed out carries none of it.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gaugework.config import DEFAULTS, ROW_ID, Thresholds
from gaugework.operators import cleaning
from gaugework.session import col, cut_lineage, small_frame

ACTIONS = ("handle_missing", "remove_duplicates", "fix_type", "handle_outliers")
LOG_SCHEMA = (
    "step int, action string, column string, strategy string, rows_before bigint, rows_after bigint, "
    "rows_removed bigint, missing_before bigint, missing_after bigint, outliers_treated bigint, "
    "original_type string, new_type string"
)


def step_priority(step: dict) -> int:
    """0 for changes in place, 1 for removing outlier rows, 2 for dropping rows or columns."""
    action, strategy = step["action"], step.get("strategy")
    if action == "handle_outliers" and strategy == "remove":
        return 1
    if action == "remove_duplicates" or strategy in ("drop_rows", "drop_column"):
        return 2
    return 0


def _needs_statistic(step: dict) -> bool:
    """Whether a step looks at the whole table before it can change it."""
    if step["action"] == "fix_type":
        return step["target_type"] == "datetime"
    return step.get("strategy") in ("fill_mean", "fill_median", "fill_mode", "ffill", "bfill", "cap_iqr")


def _shuffles(step: dict) -> bool:
    return step["action"] == "remove_duplicates" or step.get("strategy") in ("remove", "replace_nan", "ffill", "bfill")


class CleaningPipeline:
    """``add_step`` what to do, ``execute`` it on a table, then ``get_log``."""

    def __init__(self, row_id: str = ROW_ID, order_by: str | None = None, thresholds: Thresholds = DEFAULTS):
        self.row_id = row_id
        self.order_by = order_by or row_id
        self.thresholds = thresholds
        self._steps: list[dict] = []
        self._entries: list[dict] = []
        self._watched: DataFrame | None = None
        self._states: list[tuple[DataFrame, Observation, list[str]]] = []
        self._log: list[dict] | None = None

    def add_step(self, step: dict) -> "CleaningPipeline":
        """A dict with ``action`` and what it needs: column, strategy, value, keep,
        target_type, or ids (a DataFrame holding the row-id column)."""
        self._steps.append(dict(step))
        return self

    def get_steps(self) -> list[dict]:
        return list(self._steps)

    def clear(self) -> None:
        self._steps = []
        self._forget()

    def __len__(self) -> int:
        return len(self._steps)

    def _forget(self) -> None:
        self._entries, self._states, self._watched, self._log = [], [], None, None

    def execute(self, df: DataFrame, tiered: bool = False) -> DataFrame:
        """The cleaned table (lazy).  ``tiered`` orders the steps by ``step_priority``."""
        self._forget()
        steps = sorted(self._steps, key=step_priority) if tiered else self._steps
        for step in steps:
            self._check(step)
        if not steps:
            self._log = []
            return df
        current, watched = df, self._watch(df, steps[:1])
        shuffled = False
        for at, step in enumerate(steps):
            if shuffled and _needs_statistic(step):  # else each statistic would run the shuffles before it again
                current, shuffled = cut_lineage(current), False
            change = self._plan(current, step)
            shuffled = shuffled or _shuffles(step)
            entry = self._entry(at, step, current)
            current, watched = change(current), change(watched)
            if step["action"] == "fix_type":
                entry["new_type"] = current.schema[step["column"]].dataType.simpleString()
            watched = self._watch(watched, steps[at : at + 2])
            self._entries.append(entry)
        self._watched = watched
        return current

    def _check(self, step: dict) -> None:
        if step["action"] not in ACTIONS:
            raise ValueError(f"Unknown action '{step['action']}'")

    def _plan(self, df: DataFrame, step: dict) -> cleaning.Transform:
        action = step["action"]
        if action == "handle_missing":
            return cleaning.plan_missing(df, step["strategy"], step["column"], step.get("value"), self.order_by)
        if action == "remove_duplicates":
            return lambda t: cleaning.remove_duplicates(t, step.get("keep", "first"), self.row_id)
        if action == "fix_type":
            return cleaning.plan_type(df, step["column"], step["target_type"])
        return cleaning.plan_outliers(df, step["column"], step["ids"], step["strategy"], self.row_id, self.thresholds)

    # -- log ----------------------------------------------------------------

    def _watch(self, df: DataFrame, around: list[dict]) -> DataFrame:
        """Observe row count, and the gaps of the columns the steps around look at."""
        watched = {s["column"] for s in around if s["action"] == "handle_missing" and s["column"] in df.columns}
        names = sorted(watched)
        seen = Observation()
        metrics = [F.count(F.lit(1)).alias("rows")]
        metrics += [F.count_if(col(c).isNull()).alias(f"gaps_{i}") for i, c in enumerate(names)]
        self._states.append((df, seen, names))
        return df.observe(seen, *metrics)

    def _entry(self, at: int, step: dict, before: DataFrame) -> dict:
        action, column = step["action"], step.get("column")
        strategy = step.get("strategy")
        if action == "fix_type":
            strategy = f"to_{step['target_type']}"
        if action == "remove_duplicates":
            keep = step.get("keep", "first")
            strategy = f"keep_{keep}" if keep in ("first", "last") else "remove_all"
        entry = {"step": at + 1, "action": action, "column": column, "strategy": strategy}
        if action == "fix_type":
            entry["original_type"] = before.schema[column].dataType.simpleString()
        if action == "handle_outliers":
            ids = cleaning.id_frame(before, step["ids"], self.row_id)
            entry["_treated"] = (before, ids)
        return entry

    def _counts(self, state: tuple[DataFrame, Observation, list[str]]) -> dict:
        df, seen, names = state
        try:
            found = seen.get
        except Py4JJavaError:  # an empty branch was optimised away with its metrics: count it directly
            found = df.agg(
                F.count(F.lit(1)).alias("rows"),
                *[F.count_if(col(c).isNull()).alias(f"gaps_{i}") for i, c in enumerate(names)],
            ).first().asDict()
        return {"rows": found["rows"]} | {c: found[f"gaps_{i}"] for i, c in enumerate(names)}

    def get_log(self) -> list[dict]:
        """One entry per step; the first call runs the steps once to count."""
        if self._log is not None:
            return list(self._log)
        if self._watched is None:
            return []
        self._watched.agg(F.count(F.lit(1))).collect()
        states = [self._counts(s) for s in self._states]
        log = []
        for at, entry in enumerate(self._entries):
            before, after = states[at], states[at + 1]
            done = {k: v for k, v in entry.items() if not k.startswith("_")}
            done |= {
                "rows_before": before["rows"],
                "rows_after": after["rows"],
                "rows_removed": before["rows"] - after["rows"],
            }
            if entry["action"] == "handle_missing":
                done["missing_before"] = before[entry["column"]]
                done["missing_after"] = after.get(entry["column"], 0)
            if "_treated" in entry:
                table, ids = entry["_treated"]
                if entry["strategy"] == "remove":
                    done["outliers_treated"] = done["rows_removed"]
                else:
                    done["outliers_treated"] = table.join(ids, self.row_id, "left_semi").count()
            log.append(done)
        self._log = log
        return list(log)

    def log_frame(self, df: DataFrame) -> DataFrame:
        """The log as a DataFrame (one row per step)."""
        return small_frame(df.sparkSession, self.get_log(), LOG_SCHEMA)
