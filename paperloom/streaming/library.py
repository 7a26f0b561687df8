"""Reading lists kept as the state of a stream: one list for each user, each action answered.

The state is a map of papers to the number of the action that put them on the list, and
a counter: an action reads and writes the paper's own entry, however long the list is.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``seq`` gives a list's order; ``persisted`` is false for writes that failed.
ANSWER = "user_id string, paper_id string, action string, at long, in_library boolean, changed boolean, persisted boolean, seq long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lists(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "paper_id string", "seq long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        # A micro-batch's actions of one user, put in order; across batches they count as they come.
        for r in sorted(rows, key=lambda r: (r["at"], r["paper_id"], r["action"])):
            paper = (r["paper_id"],)
            on = self.places.containsKey(paper)
            wanted = {"add": True, "remove": False}.get(r["action"], not on)
            changed, kept = wanted != on, not r["fails"]
            seq = self.places.getValue(paper)[0] if on else None
            if changed and kept:
                if wanted:
                    seq = (self.count.get()[0] if self.count.exists() else 0) + 1
                    self.count.update((seq,))
                    self.places.updateValue(paper, (seq,))
                else:
                    self.places.removeKey(paper)
                    seq = None
            # A write that fails leaves the list as it was stored.
            yield Row(user_id=key[0], paper_id=r["paper_id"], action=r["action"], at=r["at"], in_library=wanted if kept else on, changed=changed and kept, persisted=kept, seq=seq)

    def close(self) -> None:
        pass


def answered(actions: DataFrame) -> DataFrame:
    """An answer for each of ``actions`` (user_id, paper_id, action, at, and fails if writes can fail).

    ``add`` changes nothing for a paper on the list, ``remove`` nothing for one that isn't;
    ``toggle`` does whichever applies; a paper put back goes last.  Blank or null ids, null
    users, other actions and actions without ``at`` get no answer.  Needs the RocksDB state
    store (:data:`PROVIDER`) and ``update`` mode.  A micro-batch's actions of one user are put in order
    in memory: bound it by the source's trigger options.  A table is a job for
    :func:`paperloom.operators.library.replay`; here it would start from empty lists.
    """
    fails = F.coalesce(F.col("fails"), F.lit(False)) if "fails" in actions.columns else F.lit(False)
    rows = actions.select(F.col("user_id").cast("string").alias("user_id"), F.trim(F.col("paper_id").cast("string")).alias("paper_id"), "action", F.col("at").cast("long").alias("at"), fails.alias("fails"))
    valid = rows.where(F.col("action").isin("add", "remove", "toggle") & (F.col("paper_id") != "") & F.col("user_id").isNotNull() & F.col("at").isNotNull())
    return valid.groupBy("user_id").transformWithState(statefulProcessor=Lists(), outputStructType=ANSWER, outputMode="Update", timeMode="None")


def lists(answers: DataFrame) -> DataFrame:
    """What is on the lists after ``answers``, in order: ``user_id, paper_id, seq``."""
    changes = answers.where("changed")
    # Of a paper's changes the last one decides; numbers of one user's answers only grow.
    last = changes.groupBy("user_id", "paper_id").agg(F.max_by(F.struct("in_library", "seq"), F.col("at")).alias("l"))
    return last.where("l.in_library").select("user_id", "paper_id", "l.seq")
