"""Connected components of a link table, as DataFrame joins with written tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_kept, keep


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) -> (id, class_id): the smallest id of each component; ids without link don't appear.

    Each round every id takes the smallest label among its neighbours, then the
    label of its label (pointer jumping). Both are equi-joins of two shuffled
    sides, which AQE splits for hub ids; the minimum is combined before the shuffle.
    """
    both = keep(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("lab")).withColumnRenamed("a", "id"), "labels")
    while True:
        sent = (both.join(labels, both.a == labels.id).select(F.col("b").alias("id"), "lab")
                .union(labels.select("id", "lab")).groupBy("id").agg(F.min("lab").alias("lab")))
        up = labels.select(F.col("id").alias("lab"), F.col("lab").alias("root"))
        jumped = sent.join(up, "lab").select("id", F.least("lab", "root").alias("lab"))
        new = keep(jumped.join(labels.withColumnRenamed("lab", "old"), "id").select("id", "lab", "old"), "labels")
        drop_kept(labels)
        changed = new.where("lab <> old").limit(1).count()
        labels = new.select("id", "lab")
        if not changed:
            drop_kept(both)
            return labels.withColumnRenamed("lab", "class_id")
