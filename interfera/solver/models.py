"""How a station's bandpass may vary: a function of frequency, in blocks of channels, and in time.

A model of a track is ``PER_CHANNEL`` (any value in any channel), ``FLAT``, ``DELAY`` or ``Polynomial(n)``; with ``Blocks``
it holds in each block of channels, and ``Sum`` adds up several. A ``Spec`` says so for one track and whether it is
fitted for each scan; a ``Feed`` has one for phases and one for logarithmic amplitudes; a ``Station`` has a reference
feed, its ``Feed``, and another for the ratio of the two feeds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol


class Model(Protocol):
    """What a track's model must have to be used by the solver."""

    def label(self) -> str: ...
    def parameters(self) -> int | None: ...


@dataclass(frozen=True)
class PerChannel:
    def label(self) -> str:
        return "per_channel"

    def parameters(self) -> int | None:
        return None


@dataclass(frozen=True)
class Flat:
    def label(self) -> str:
        return "flat"

    def parameters(self) -> int | None:
        return 0


@dataclass(frozen=True)
class Delay:
    def label(self) -> str:
        return "delay"

    def parameters(self) -> int | None:
        return 1


@dataclass(frozen=True)
class Polynomial:
    degree: int

    def label(self) -> str:
        return f"poly{self.degree}"

    def parameters(self) -> int | None:
        return self.degree


PER_CHANNEL, FLAT, DELAY = PerChannel(), Flat(), Delay()


@dataclass(frozen=True)
class Blocks:
    """A model in each block of ``size`` channels; 0: in all channels at once."""

    model: Model
    size: int = 0

    def __post_init__(self):
        if self.size < 0 or isinstance(self.model, (Blocks, Sum)):
            raise ValueError("blocks have a size of 1 or more and a plain model")

    def label(self) -> str:
        return f"{self.model.label()}@{_blocks_label(self.size)}"

    def parameters(self) -> int | None:
        return self.model.parameters()


@dataclass(frozen=True)
class Sum:
    parts: tuple[Blocks, ...]

    def __post_init__(self):
        if not self.parts:
            raise ValueError("a sum has one part at least")

    def label(self) -> str:
        return "+".join(p.label() for p in self.parts)

    def parameters(self) -> int | None:
        return sum(p.parameters() or 0 for p in self.parts)


def _blocks_label(size: int) -> str:
    return f"block{size}" if size else "global"


def evaluate(model: Model, parameters: list[float], f: float) -> float:
    """A plain model at a frequency; models by channel or in blocks have no value there."""
    if model.parameters() is None or isinstance(model, (Blocks, Sum)):
        raise ValueError(f"{model.label()} has values by channel alone")
    if len(parameters) != model.parameters():
        raise ValueError(f"{model.label()} takes {model.parameters()} parameters")
    return float(sum(p * f ** (k + 1) for k, p in enumerate(parameters)))


def segments(size: int, channels: int) -> list[range]:
    """The blocks of channels from 0; the last may be short."""
    return [range(i, min(i + size, channels)) for i in range(0, channels, size)] if size else [range(channels)]


@dataclass(frozen=True)
class Spec:
    model: Model = PER_CHANNEL
    blocks: int = 0
    per_scan: bool = False

    def parts(self) -> tuple[Blocks, ...]:
        if isinstance(self.model, Sum):
            return self.model.parts
        return (self.model,) if isinstance(self.model, Blocks) else (Blocks(self.model, self.blocks),)

    def free(self) -> bool:
        """Any value in any channel: nothing is fitted."""
        return all(isinstance(p.model, PerChannel) for p in self.parts()) and len(self.parts()) == 1

    def label(self) -> str:
        plain = self.model.label()
        return plain if isinstance(self.model, (Blocks, Sum)) or not self.blocks else f"{plain}@{_blocks_label(self.blocks)}"

    def freedom(self, channels: int) -> int:
        """Parameters that each scan adds."""
        if not self.per_scan:
            return 0
        if not isinstance(self.model, (Blocks, Sum)):
            n = self.model.parameters()
            return channels if n is None else n
        each = lambda p: channels if p.parameters() is None else len(segments(p.size, channels)) * (1 if isinstance(p.model, Flat) else p.parameters())
        return sum(each(p) for p in self.parts())


@dataclass(frozen=True)
class Feed:
    phase: Spec = field(default_factory=Spec)
    amplitude: Spec = field(default_factory=Spec)

    def __post_init__(self):
        if any(isinstance(p.model, Delay) for p in self.amplitude.parts()):
            raise ValueError("an amplitude has no delay")


@dataclass(frozen=True)
class Station:
    reference_feed: int = 1
    reference: Feed = field(default_factory=Feed)
    relative: Feed = field(default_factory=Feed)

    def __post_init__(self):
        if self.reference_feed not in (1, 2):
            raise ValueError("the reference feed is 1 or 2")

    def per_scan(self, what: str, feed: int) -> bool:
        """Whether the feed's phase or amplitude is fitted for each scan; the other feed hangs on both."""
        own = getattr(self.reference, what).per_scan
        return own if feed == self.reference_feed else own or getattr(self.relative, what).per_scan

    def summary(self, name: str) -> str:
        time = lambda s: "per_scan" if s.per_scan else "global"
        part = lambda f: f"phase={f.phase.label()}, phase_time={time(f.phase)}, amp={f.amplitude.label()}, amp_time={time(f.amplitude)}"
        return f"{name} ref={self.reference_feed} abs({part(self.reference)}) rel({part(self.relative)})"


def stations(names: list[str], special: dict[str, Station], default: Station = Station()) -> list[Station]:
    """A model for each station; a special one of an unknown station is an error."""
    if unknown := sorted(set(special) - set(names)):
        raise ValueError(f"unknown stations: {', '.join(unknown)}")
    return [special.get(n, default) for n in names]
