"""Evolutionary search over feature subsets and the strength of regularisation.

The data is read once, for the moments of each fold. After that a candidate is judged from these few small
matrices where they are, without another job; candidates that the history table already holds are not judged
again.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.models.linear import CrossValidation, assign_folds, collect_grams, cross_validate_grams, gram

HISTORY_SCHEMA = "generation int, key string, mask array<int>, lam double, fitness double, description string"
#: Generations of entries that are no part of the search proper: the winner on more folds, and the candidate it has to beat.
FINAL, DEFAULT = -1, -2


@dataclass(frozen=True)
class SearchConfig:
    population: int = 20
    generations: int = 20
    k: int = 2
    retrain_k: int = 10
    mutation_rate: float = 0.8
    recombination_rate: float = 0.8
    lam: tuple[float, float] = (0.0001, 0.2)
    default_lam: float = 0.05
    penalty: float = 0.0
    places: int = 5
    seed: int = 42
    fold_method: str = "balanced"


@dataclass(frozen=True)
class Candidate:
    mask: tuple[int, ...]
    lam: float
    fitness: float | None = None

    @property
    def key(self) -> str:
        return f"mask_{''.join(map(str, self.mask))}_lam_{self.lam}"

    def features(self, x: Sequence[str]) -> list[str]:
        return [c for c, used in zip(x, self.mask) if used]

    def describe(self, x: Sequence[str], fitness: float) -> str:
        """The candidate and its error in words, as the log shows it."""
        return f"features: {', '.join(self.features(x))}; lambda: {self.lam}; fitness: {fitness:.4f}"


def fold_grams(df: DataFrame, x: Sequence[str], y: str, key: str, k: int, seed: int, method: str) -> dict:
    complete = df.select(key, *x, y).na.drop(subset=[*x, y])
    folded = assign_folds(complete, key, k, seed, method=method)
    return {fold: m for (fold,), m in collect_grams(gram(folded, x, y, ["fold"]), len(x) + 1).items()}


def score(candidate: Candidate, grams: dict, x: Sequence[str], penalty: float = 0.0) -> float:
    """Mean validation error of a candidate, plus `penalty` per used feature."""
    used = [i + 1 for i, bit in enumerate(candidate.mask) if bit]
    return cross_validate_grams(grams, x, used, candidate.lam).mse + penalty * len(used)


class _Breeder:
    """Seeded random changes of candidates."""

    def __init__(self, n_features: int, config: SearchConfig):
        self.n, self.config, self.rng = n_features, config, random.Random(config.seed)

    def _some(self, mask: list[int]) -> tuple[int, ...]:
        if not any(mask):
            mask[self.rng.randrange(self.n)] = 1
        return tuple(mask)

    def fresh(self) -> Candidate:
        mask = [self.rng.randint(0, 1) for _ in range(self.n)]
        return Candidate(self._some(mask), round(self.rng.uniform(*self.config.lam), self.config.places))

    def parents(self, population: list[Candidate]) -> tuple[Candidate, Candidate]:
        worth = [1.0 / c.fitness if c.fitness else float("1e300") for c in population]
        low, high = min(worth), max(worth)
        weights = [(w - low) / (high - low) for w in worth] if high > low else [1.0] * len(worth)
        first, second = self.rng.choices(population, weights=weights, k=2)
        return first, second

    def recombine(self, a: Candidate, b: Candidate) -> list[Candidate]:
        if self.rng.random() >= self.config.recombination_rate:
            return [a, b]
        swap = [self.rng.random() < 0.5 for _ in range(self.n)]
        lams = [a.lam, b.lam] if self.rng.random() < 0.5 else [b.lam, a.lam]
        one = [v if s else w for v, w, s in zip(a.mask, b.mask, swap)]
        two = [w if s else v for v, w, s in zip(a.mask, b.mask, swap)]
        return [Candidate(self._some(one), lams[0]), Candidate(self._some(two), lams[1])]

    def mutate(self, c: Candidate) -> Candidate:
        mask, lam = list(c.mask), c.lam
        if self.rng.random() < self.config.mutation_rate:
            i = self.rng.randrange(self.n)
            mask[i] = 1 - mask[i]
        if self.rng.random() < self.config.mutation_rate:
            lam = lam * 2 if self.rng.random() < 0.5 else max(self.config.lam[0], lam / 2)
        return Candidate(self._some(mask), round(lam, self.config.places))


def search(
    df: DataFrame, x: Sequence[str], y: str, key: str, config: SearchConfig = SearchConfig(), history: DataFrame | None = None
) -> tuple[Candidate, DataFrame]:
    """Best candidate and the history of everything judged.

    It begins with the default candidate, all features with the default penalty (generation DEFAULT), which is judged and
    takes no part in the search, and ends with the winner on more folds (generation FINAL).
    """
    spark, x = df.sparkSession, list(x)
    grams = fold_grams(df, x, y, key, config.k, config.seed, config.fold_method)
    breeder = _Breeder(len(x), config)
    log: list[tuple] = []

    memo = {}
    if history is not None:  # as many rows as earlier searches have judged candidates
        past = history.where(F.col("generation") != FINAL).groupBy("key").agg(F.min("fitness").alias("fitness"))
        memo = {row["key"]: row["fitness"] for row in past.collect()}

    def judged(candidates: list[Candidate], generation: int) -> list[Candidate]:
        new = {c.key: c for c in candidates if c.key not in memo}
        for key_, c in sorted(new.items()):
            memo[key_] = score(c, grams, x, config.penalty)
            log.append((generation, key_, list(c.mask), c.lam, memo[key_], c.describe(x, memo[key_])))
        return [Candidate(c.mask, c.lam, memo[c.key]) for c in candidates]

    judged([Candidate((1,) * len(x), config.default_lam)], DEFAULT)
    population = judged([breeder.fresh() for _ in range(config.population)], 0)
    for generation in range(1, config.generations + 1):
        children = []
        for _ in range(config.population // 2):
            children += breeder.recombine(*breeder.parents(population))
        children = judged([breeder.mutate(c) for c in children], generation)
        population = sorted(population + children, key=lambda c: (c.fitness, c.key))[: config.population]
    best = min(population, key=lambda c: (c.fitness, c.key))
    final = retrain(df, x, y, key, best, config)
    log.append((FINAL, best.key, list(best.mask), best.lam, final.mse, best.describe(x, final.mse)))
    return best, spark.createDataFrame(log, HISTORY_SCHEMA)


def retrain(df: DataFrame, x: Sequence[str], y: str, key: str, best: Candidate, config: SearchConfig = SearchConfig()) -> CrossValidation:
    """The winner fitted and scored again on more folds."""
    grams = fold_grams(df, x, y, key, config.retrain_k, config.seed, config.fold_method)
    used = [i + 1 for i, bit in enumerate(best.mask) if bit]
    return cross_validate_grams(grams, list(x), used, best.lam)


def progress(history: DataFrame) -> DataFrame:
    """Best fitness of each generation of the search proper."""
    real = history.where(F.col("generation") >= 0)
    return real.groupBy("generation").agg(F.min("fitness").alias("fitness"))
