"""Writes approved proposals as a stand-alone PySpark script: literal edits as joins, repeats dropped by a window."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .engine import Applied, Proposed
from .rules import Proposal

MAX_LITERAL = 2000  # distinct edits a script carries itself; more go to a table beside it

SCRIPT = '''"""Cleaning script, made from approved proposals. Usage: python {name} INPUT.csv OUTPUT_DIR"""

import json
import sys

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = json.loads({columns!r})
VALUE_EDITS = json.loads({values!r})  # column, old text, new text
CELL_EDITS = json.loads({cells!r})  # row, column, old text, new text
EDIT_TABLE = {table!r}
DROP_REPEATS = {drop!r}


def main(source, target):
    spark = SparkSession.builder.appName("clean").getOrCreate()
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(source).na.fill("")
    schema = df.schema.add("_row_id", "long")
    df = df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(schema)
    for c in COLUMNS:
        own = {{old: new for column, old, new in VALUE_EDITS if column == c}}
        if own:
            pairs = [F.lit(x) for kv in own.items() for x in kv]
            df = df.withColumn(c, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(f"`{{c}}`")), F.col(f"`{{c}}`")))
    edits = spark.read.parquet(EDIT_TABLE) if EDIT_TABLE else spark.createDataFrame([tuple(x) for x in CELL_EDITS], "row bigint, column string, old string, new string")
    wide = edits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("column", "new"))).alias("_m"))
    df = df.join(wide, F.col("_row_id") == F.col("row"), "left")
    df = df.select("_row_id", *[F.coalesce(F.try_element_at("_m", F.lit(c)), F.col(f"`{{c}}`")).alias(c) for c in COLUMNS])
    if DROP_REPEATS:
        w = Window.partitionBy(*[f"`{{c}}`" for c in COLUMNS]).orderBy("_row_id")
        df = df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    df.orderBy("_row_id").drop("_row_id").write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(target)


if __name__ == "__main__":
    main(*sys.argv[1:3])
'''


def script(proposed: Proposed, approved: list[Proposal], applied: Applied, name: str = "clean_table.py", table: str | None = None) -> str:
    """The script that repeats the application on the same file.

    An old text that always becomes the same new text in its column, wherever it stands, is an edit by value; other edits go by row. With
    more than MAX_LITERAL edits by row they are written to `table` and joined from there.
    """
    edits = applied.diff.filter("column <> '__ROW__' and rule_id <> 'MANUAL_EDIT'").select(F.col("row").cast("bigint").alias("row"), "column", F.col("old_value").alias("old"), F.col("new_value").alias("new"))
    from .values import long_form

    per = edits.groupBy("column", "old").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("new").alias("kinds"), F.first("new").alias("new"))
    seen = long_form(proposed.table.frame, proposed.table.columns).groupBy("column", F.col("value").alias("old")).agg(F.count(F.lit(1)).alias("all"))
    by_value = per.join(seen, ["column", "old"]).filter((F.col("kinds") == 1) & (F.col("n") == F.col("all")) & (F.col("old") != ""))
    values = by_value.select("column", "old", "new").orderBy("column", "old").limit(MAX_LITERAL + 1).collect()
    if len(values) > MAX_LITERAL:
        values, rest = [], edits
    else:
        rest = edits.join(by_value.select("column", "old"), ["column", "old"], "left_anti")
    cells = rest.select("row", "column", "old", "new").limit(MAX_LITERAL + 1).collect()
    where = None
    if len(cells) > MAX_LITERAL:
        if table is None:
            raise ValueError("the edits need a table; name one")
        rest.select("row", "column", "old", "new").write.mode("overwrite").parquet(table)
        cells, where = [], table
    drop = any(p.drops_rows for p in approved)
    dump = lambda rows: json.dumps([list(r) for r in rows], ensure_ascii=False)
    return SCRIPT.format(name=name, columns=json.dumps(proposed.table.columns, ensure_ascii=False), values=dump(values), cells=dump(cells), table=where, drop=drop)
