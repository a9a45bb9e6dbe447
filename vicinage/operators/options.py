"""Options of the vectorizers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class GraphOptions:
    """r and d bound radius and distance; ``complexity`` sets both where they aren't given."""

    complexity: int = 3
    r: int | None = None
    d: int | None = None
    min_r: int = 0
    min_d: int = 0
    weights_dict: tuple[tuple[int, int, float], ...] | None = None
    auto_weights: bool = False
    nbits: int = 16
    normalization: bool = True
    inner_normalization: bool = True
    positional: bool = False
    discrete: bool = True
    use_only_context: bool = False

    def __post_init__(self):
        if not 1 <= self.nbits <= 31:
            raise ValueError(f"nbits is {self.nbits}, not in 1 to 31")
        if min(self.radius, self.distance, self.min_r, self.min_d) < 0:
            raise ValueError("radius and distance are 0 or more")

    @property
    def radius(self) -> int:
        return self.complexity if self.r is None else self.r

    @property
    def distance(self) -> int:
        return self.complexity if self.d is None else self.d

    @property
    def bucket_weights(self) -> dict[tuple[int, int], float] | None:
        if self.auto_weights:
            return {(i, i + 1): 1.0 for i in range(max(self.radius, self.distance))}
        return None if self.weights_dict is None else {(r, d): w for r, d, w in self.weights_dict}

    def set_params(self, **args) -> GraphOptions:
        """A changed copy; a new complexity resets r and d unless they are given, too."""
        if "complexity" in args:
            args = {"r": None, "d": None} | args
        return replace(self, **args)

    def get_params(self) -> dict:
        return asdict(self)

    def saved(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loaded(cls, text: str):
        args = json.loads(text)
        if args.get("weights_dict") is not None:
            args["weights_dict"] = tuple(map(tuple, args["weights_dict"]))
        return cls(**args)


@dataclass(frozen=True)
class SequenceOptions(GraphOptions):
    r: int | None = 3
    d: int | None = 3

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "min_r", min(self.min_r, self.radius))
        object.__setattr__(self, "min_d", min(self.min_d, self.distance))

    @property
    def bucket_weights(self) -> dict[tuple[int, int], float] | None:
        if self.auto_weights:
            return {(i, i): 1.0 for i in range(max(self.radius, self.distance) + 1)}
        return None if self.weights_dict is None else {(r, d): w for r, d, w in self.weights_dict}


#: Places of a key by the name of the offset.
OFFSETS = {"small": 10, "large": 25, "very_large": 50}


def described(values: dict, full: bool = True, offset: str = "small") -> str:
    """``key: value`` lines in order of the keys, aligned at the colon; unless ``full``, the middle of long lines is left out."""
    if offset not in OFFSETS:
        raise ValueError(f"unknown offset: {offset}")
    lines = [f"{key!s:>{OFFSETS[offset]}}: {values[key]}".replace("\n", " ") for key in sorted(values)]
    return "\n".join(x if full or len(x) <= 100 else f"{x[:100]}  ...  {x[-20:]}" for x in lines)
