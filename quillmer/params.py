"""Parameters of a run, with the defaults of the command line."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    k: int = 23
    min_count: int = 2
    max_count: int = 65535
    iterations: int = 100
    min_similarity: float = 0.80
    start_similarity: float = 0.95
    p_value: float = 0.01
    vote: float = 0.5
    size_threshold: int = 500_000
    ignore_small: int = 5
    bucket_threshold: int = 20_000
    rarity: float = 0.1
    invalid: str = "skip"
    test: str = "student"
    seed: int = 1
    warm_up_rounds: int = 0
