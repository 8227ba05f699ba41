"""N-gram presence bitmasks: document frequencies, features by decision-tree induction, masks, scans."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.keys import entropy, folded, ngrams

#: Bits of a mask, at most.
WIDEST = 16


@dataclass(frozen=True)
class Features:
    """Selected n-grams by bit."""

    grams: tuple[str, ...]
    ngram: int
    name: str = "fp16_chars"

    def mask(self, pattern: str) -> int:
        """Bits of the features in the pattern: 0, no filter, if it has none."""
        low = pattern.lower()
        return sum(1 << i for i, g in enumerate(self.grams) if len(low) >= self.ngram and g in low)

    def column(self, text: Column) -> Column:
        """Presence of each feature: a string has an n-gram exactly if it contains it."""
        low, out = folded(text), F.lit(0)
        for i, g in enumerate(self.grams):
            out = out.bitwiseOR(F.when(low.contains(g), F.lit(1 << i)).otherwise(F.lit(0)))
        return out.cast("int")

    def to_json(self) -> str:
        return json.dumps({"selected_features": list(self.grams), "ngram": self.ngram}, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Features:
        """Also reads the older form, single characters under another name."""
        data = json.loads(text)
        return Features(tuple(data.get("selected_features") or data["selected_chars"]), data.get("ngram", 1))


def presence(df: DataFrame, column: str, n: int, *ids: str) -> DataFrame:
    """A row for each distinct n-gram of each row."""
    return df.select(*ids, F.explode(F.array_distinct(ngrams(folded(F.col(column)), n))).alias("gram"))


def document_frequency(df: DataFrame, column: str, n: int) -> DataFrame:
    """gram, n_docs and its share of all rows, in one pass over the n-grams."""
    total = df.count()
    return presence(df, column, n).groupBy("gram").agg(F.count("*").alias("n_docs")).withColumn("share", F.col("n_docs") / F.lit(max(total, 1)))


def candidates(df: DataFrame, column: str, n: int, max_share: float) -> DataFrame:
    return document_frequency(df, column, n).where((F.col("share") > 0) & (F.col("share") <= max_share))


def split_scores(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """Entropy times size for each part (rows: id, part) and gram (grams: id, gram) present in it, rounded to nine digits."""
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    counted = grams.join(rows, "id").groupBy("part", "gram").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(sizes), "part").withColumn("score", F.round(entropy(F.col("n") / F.col("size")) * F.col("size"), 9))  # a part for each split so far


def select_features(df: DataFrame, column: str, id_column: str, bits: int = WIDEST, n: int = 2, max_share: float = 1.0, saved=None) -> Features:
    """`bits` features: each step splits the part and by the gram of greatest weighted entropy; ties go to the earlier part and smaller gram.

    One small job for each bit over the exploded n-grams, which are kept in memory and disk. A part splits into rows without and with the gram.
    """
    if not 1 <= bits <= WIDEST:
        raise ValueError(f"a mask has 1 to {WIDEST} bits")
    allowed = candidates(df, column, n, max_share)
    grams = presence(df, column, n, F.col(id_column).alias("id")).join(allowed.select("gram"), "gram").persist()
    rows, chosen, order, earlier = df.select(F.col(id_column).alias("id"), F.lit(0).alias("part")), [], [0], []
    try:
        unused = [r.gram for r in allowed.orderBy("gram").limit(bits).collect()]
        if len(unused) < bits:
            raise ValueError(f"{len(unused)} n-grams qualify, {bits} are needed")
        for step in range(bits):
            place = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(order) for x in (p, i)]), F.col("part"))
            scored = split_scores(rows, grams).where(~F.col("gram").isin(chosen) if chosen else F.lit(True))
            best = scored.withColumn("place", place).orderBy(F.desc("score"), "place", "gram").limit(1).collect()
            if best and best[0].score > 0:
                part, gram = best[0].part, best[0].gram
            else:  # nothing is left to split: the smallest gram that is unused
                spare = allowed.where(~F.col("gram").isin(chosen)) if chosen else allowed
                part, gram = order[0], spare.agg(F.min("gram")).first()[0]
            for old in earlier:  # the rows of this step have been computed
                old.unpersist()
            earlier = [rows]
            chosen.append(gram)
            has = grams.where(F.col("gram") == gram).select("id", F.lit(1).alias("has"))
            rows = rows.join(has, "id", "left").select("id", F.when((F.col("part") == part) & (F.col("has") == 1), F.lit(2 * step + 2)).when(F.col("part") == part, F.lit(2 * step + 1)).otherwise(F.col("part")).alias("part")).persist()
            order = [p for p in order if p != part] + [2 * step + 1, 2 * step + 2]
    finally:
        for kept in (grams, rows, *earlier):
            kept.unpersist()
    return Features(tuple(chosen), n)


def scan(df: DataFrame, column: str, pattern: str, features: Features | None = None) -> DataFrame:
    """Number and least of the strings that contain the pattern, masks first if features are given."""
    text = F.lower(F.col(column)).contains(pattern.lower())
    mask = features.mask(pattern) if features else 0
    keep = (F.col(features.name).bitwiseAND(F.lit(mask)) == mask) & text if mask else text
    return df.where(keep).agg(F.count("*").alias("match_count"), F.min(column).alias("least"))
