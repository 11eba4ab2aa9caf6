"""Importance resampling towards a target corpus, by hashed n-grams read from a table of word positions.

Words stand in a table (document, position, word); ``lead`` over a document's rows brings the words that follow
beside each word, which makes the n-grams of all orders that begin there. Their buckets are counted over both corpora,
a bucket's gain says how much more often it occurs in the target, and gains are joined back and summed by document.
Gumbel noise from a hash of the id turns weights into a draw without replacement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import running_sums
from lodestone.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII that is neither letter nor digit.
BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does that, faster, where all is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


class ImportanceResampling:
    """Draws ``percent`` of the documents of at least ``least_words`` words, those most like the target likelier.

    ``orders`` is the longest run of words that is a feature, ``buckets`` the number of buckets that features are
    hashed to, ``seed`` that of the noise.
    """

    def __init__(self, orders: int = 3, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42):
        self.orders, self.buckets, self.percent, self.least_words, self.seed = orders, buckets, percent, least_words, seed

    def run(self, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
        """(doc_id, n_words, n_features, weight, score, rank) for each row of ``docs``.

        Words are lower-cased (A-Z) runs without ASCII but letters and digits; null and empty texts have none and weigh
        0. Rows that repeat count as often as they stand there, each has a rank of its own where drawn, and equal scores
        go to the smaller id. A row without an id counts for the corpus; its score and rank are null and it takes no part
        in the draw. An empty target makes all gains small ones of the corpus alone; empty ``docs`` give no rows. Other
        columns are not read.
        """
        d = self._distinct(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
        table = materialize(self.positions(d))
        t = self._distinct(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")))
        gains = self.gains(self._counts(table), self._counts(self.positions(t)))
        found = table
        for k in self._orders():
            found = found.join(gains.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}")), f"b{k}", "left")
        gain = reduce(Column.__add__, [F.coalesce(f"g{k}", F.lit(0)) for k in self._orders()])
        n = reduce(Column.__add__, [F.count(f"b{k}") for k in self._orders()])
        by_doc = found.groupBy("doc_id", "tag", "copies").agg(F.count("b1").alias("n_words"), n.alias("n_features"), F.sum(gain).alias("weight"))
        return self._drawn(materialize(by_doc))

    def _orders(self) -> range:
        return range(1, self.orders + 1)

    def _distinct(self, d: DataFrame) -> DataFrame:
        """(doc_id, tag, text, copies): equal rows once. It also deals whole documents to tasks, where their rows then stay."""
        return d.groupBy("doc_id", F.xxhash64("text").alias("tag")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def positions(self, d: DataFrame) -> DataFrame:
        """(doc_id, tag, copies, b1, b2, ..): a row for each word; bk is the bucket of the k words that begin there, null where fewer follow.

        A document without words has one row, of nulls.
        """
        words = F.array_remove(F.split(F.coalesce("text", F.lit("")), BREAKS), "")
        p = d.select("doc_id", "tag", "copies", F.posexplode_outer(words).alias("pos", "raw"))
        p = p.select("doc_id", "tag", "copies", "pos", lower_ascii(F.col("raw")).alias("w1"))
        order = Window.partitionBy("doc_id", "tag").orderBy("pos")
        p = p.select("*", *[F.lead("w1", k - 1).over(order).alias(f"w{k}") for k in self._orders() if k > 1])
        runs = [reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.col(f"w{j}") for j in range(1, k + 1)]) for k in self._orders()]
        return p.select("doc_id", "tag", "copies", *[(F.crc32(r.cast("binary")) % self.buckets).cast("int").alias(f"b{k}") for k, r in enumerate(runs, 1)])

    def _counts(self, positions: DataFrame) -> DataFrame:
        """(bucket, n): how often features of each bucket stand in the corpus; at most ``buckets`` rows."""
        each = positions.select("copies", F.explode(F.array(*[f"b{k}" for k in self._orders()])).alias("bucket"))
        return each.where("bucket is not null").groupBy("bucket").agg(F.sum("copies").alias("n"))

    def gains(self, corpus: DataFrame, target: DataFrame) -> DataFrame:
        """(bucket, gain) of each bucket of the corpus: a thousand times the logarithm of how much likelier it is in the target, floored."""
        corpus, target = materialize(corpus), materialize(target)
        total = lambda d, name: d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
        both = corpus.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
        both = both.join(total(corpus, "in_corpus").join(total(target, "in_target")))  # one row of totals
        smooth = lambda n, by: (F.coalesce(n, F.lit(0)) + by).cast("double")
        ratio = smooth(F.col("t"), 1) * smooth(F.col("in_corpus"), self.buckets) / (smooth(F.col("s"), 1) * smooth(F.col("in_target"), self.buckets))
        gains = materialize(both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")))
        return F.broadcast(gains) if self.buckets <= 1_000_000 else gains

    def _drawn(self, by_doc: DataFrame) -> DataFrame:
        """Each document, as often as it stands in the corpus, with its score and its place among the drawn."""
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{self.seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
        d = by_doc.withColumn("score", F.col("weight") + noise)
        able = (F.col("n_words") >= self.least_words) & F.col("doc_id").isNotNull()
        n = d.where(able).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        placed = running_sums(d.where(able), [F.desc("score"), F.asc("doc_id"), F.asc("tag")], {"upto": "copies"})
        d = placed.unionByName(d.where(~able).withColumn("upto", F.lit(None).cast("long")))
        d = d.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        place = F.col("upto") - F.col("copies") + F.col("copy")
        return d.select("doc_id", "n_words", "n_features", "weight", "score", F.when(place <= self.percent * n // 100, place).alias("rank"))
