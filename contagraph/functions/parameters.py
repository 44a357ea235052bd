"""Natural history of infection: eleven numbers and what follows from them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from numbers import Real


@dataclass(frozen=True, slots=True, kw_only=True)
class NaturalHistory:
    """Gamma-staged latent, presymptomatic and symptomatic periods, a testing delay, and a relaxed molecular clock (per site and year)."""

    incubation_shape: float = 5.807
    incubation_scale: float = 0.948
    latent_shape: float = 3.38
    symptomatic_rate: float = 0.37
    symptomatic_shape: float = 1.0
    transmission_rate_ratio: float = 2.29
    testing_delay_shape: float = 2.0
    testing_delay_scale: float = 1.0
    substitution_rate: float = 1e-3
    relaxation: float = 0.33
    genome_length: int = 29903

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, Real):
                raise TypeError(f"{f.name} must be a number")
            if value < 0 or (value == 0 and f.name != "relaxation"):
                raise ValueError(f"{f.name} must be {'at least' if f.name == 'relaxation' else 'above'} 0")
        if self.latent_shape >= self.incubation_shape:
            raise ValueError("latent_shape must be below incubation_shape")

    @property
    def presymptomatic_shape(self) -> float:
        return self.incubation_shape - self.latent_shape

    @property
    def symptomatic_scale(self) -> float:
        return 1 / (self.symptomatic_shape * self.symptomatic_rate)

    @property
    def incubation_rate(self) -> float:
        return 1 / (self.incubation_shape * self.incubation_scale)

    @property
    def _weights(self) -> tuple[float, float]:
        """Infectiousness before and after onset, up to a common factor."""
        return self.transmission_rate_ratio * self.presymptomatic_shape * self.symptomatic_rate, self.incubation_shape * self.incubation_rate

    @property
    def infectiousness_normalisation(self) -> float:
        before, after = self._weights
        return after * self.symptomatic_rate / (before + after)

    @property
    def presymptomatic_transmission_fraction(self) -> float:
        before, after = self._weights
        return before / (before + after)

    @property
    def mutations_per_day(self) -> float:
        return self.substitution_rate * self.genome_length / 365

    def to_dict(self) -> dict[str, float]:
        return asdict(self)
