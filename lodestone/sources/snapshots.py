"""Tables as versions: whole folders that are never overwritten, and a commit record that makes one of them current.

A version is written first; then its record, with row count and content hash, takes the next number by a rename that
fails where the number is taken. Readers resolve the newest record once and read that folder, so a writer that stops at
any point leaves them the version before. Old folders go when asked.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(df: DataFrame) -> str:
    """Rows and a sum over their hashes, by the columns in order of name; the order of rows does not matter."""
    names = sorted(df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    row = F.xxhash64(*[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`").isNull() for c in names]) if names else F.lit(0)
    r = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(row, F.lit(7)).cast("decimal(38,0)")).alias("b")).first()
    return f"{r['n']}-{int(r['a'] or 0):x}-{int(r['b'] or 0):x}-{','.join(f'{c}:{kinds[c]}' for c in names)}"


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _records(self) -> list[tuple[int, str]]:
        """Number and path of each record, oldest first."""
        fs, place = self._place(f"{self.path}/commits")
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted((int(n[:-5]), f"{self.path}/commits/{n}") for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, record: str) -> dict:
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(record, wholetext=True).collect()))

    def publish(self, df: DataFrame, format: str = "parquet", facts: dict | None = None) -> int:
        """Makes ``df`` the current version and gives its number; the table before stays whole until then."""
        folder = f"{self.path}/versions/{uuid.uuid4().hex}"
        df.write.format(format).option("header", True).save(folder)
        written = self.spark.read.format(format).option("header", True).schema(df.schema).load(folder)
        return self._commit({"folder": folder, "format": format, "schema": df.schema.json(), "hash": content_hash(written), "facts": facts or {}})

    def _commit(self, record: dict) -> int:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        number = max((n for n, _ in self._records()), default=0) + 1
        fs, beside = self._place(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(self._place(f"{self.path}/commits/{number:012d}.json")[1]), none)
        return number

    def current(self) -> dict | None:
        """The newest version's record, or nothing."""
        records = self._records()
        return self._read(records[-1][1]) | {"number": records[-1][0]} if records else None

    def read(self, verify: bool = False) -> DataFrame:
        """The current version. With ``verify`` its rows are hashed first, and others than were written are refused."""
        record = self.current()
        if record is None:
            raise FileNotFoundError(f"no version of {self.path}")
        from pyspark.sql.types import StructType

        d = self.spark.read.format(record["format"]).option("header", True).schema(StructType.fromJson(json.loads(record["schema"]))).load(record["folder"])
        if verify and content_hash(d) != record["hash"]:
            raise ValueError(f"{record['folder']} does not hold what was written")
        return d

    def expire(self, keep: int = 2) -> int:
        """Deletes all but the newest ``keep`` versions; readers of older ones must be done. Gives how many went."""
        old = self._records()[:-keep] if keep else self._records()
        for _, path in old:
            for place in (self._read(path)["folder"], path):
                fs, at = self._place(place)
                fs.delete(at, True)
        return len(old)
