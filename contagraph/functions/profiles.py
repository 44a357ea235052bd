"""Transmission profiles: densities over days, their numerical distribution functions, and samplers of the stages.

A profile is a driver object; its grid is small and goes to executors as a DataFrame or in a closure.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from contagraph.exceptions import ConfigurationError
from contagraph.functions.columns import interpolated
from contagraph.functions.gamma import gamma_cdf, gamma_pdf
from contagraph.functions.parameters import NaturalHistory


class TransmissionProfile:
    """Subclasses give pdf(); cdf(), mean(), rvs() and the samplers follow."""

    def __init__(self, parameters: NaturalHistory | None = None, grid_min_days: float = 0.0, grid_max_days: float = 100.0, rng: np.random.Generator | None = None, rng_seed: int | None = None, grid_points: int = 1024) -> None:
        if not grid_min_days < grid_max_days:
            raise ConfigurationError("grid_min_days must be below grid_max_days")
        if grid_points < 2:
            raise ConfigurationError("grid_points must be 2 or more")
        self.parameters = parameters or NaturalHistory()
        self.grid_min_days, self.grid_max_days, self.grid_points = grid_min_days, grid_max_days, grid_points
        self.seed = rng_seed if rng_seed is not None else int(np.random.SeedSequence().entropy % 2**63)
        self.rng = rng if rng is not None else np.random.default_rng(self.seed)
        self._grid: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.parameters!r}, grid_min_days={self.grid_min_days}, grid_max_days={self.grid_max_days}, grid_points={self.grid_points})"

    def pdf(self, days) -> np.ndarray:
        raise NotImplementedError

    def grid(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Days, density and distribution function; the latter a straight line where the density has no usable mass."""
        if self._grid is None:
            x = np.linspace(self.grid_min_days, self.grid_max_days, self.grid_points)
            f = np.maximum(np.asarray(self.pdf(x), float), 0)
            area = np.concatenate([[0], np.cumsum(np.diff(x) * (f[1:] + f[:-1]) / 2)])
            mass = area[-1]
            c = area / mass if np.isfinite(mass) and mass > 0 else (x - x[0]) / (x[-1] - x[0])
            c = np.maximum.accumulate(c)
            c[0], c[-1] = 0.0, 1.0
            self._grid = x, f, c
        return self._grid

    def grid_frame(self, spark: SparkSession) -> DataFrame:
        """k, x, pdf, cdf."""
        x, f, c = self.grid()
        return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(x, f, c))], "k int, x double, pdf double, cdf double")

    def cdf(self, days) -> np.ndarray:
        x, _, c = self.grid()
        return np.interp(np.asarray(days, float), x, c, left=0.0, right=1.0)

    def cdf_column(self, days: Column) -> Column:
        """cdf() as an expression of the engine; null and NaN give null."""
        x, _, c = self.grid()
        return interpolated(days, x, c)

    def mean(self) -> float:
        x, f, _ = self.grid()
        mass = float(np.trapezoid(f, x))
        return float(np.trapezoid(x * f, x)) / mass if np.isfinite(mass) and mass > 0 else float("nan")

    def quantile(self, u) -> np.ndarray:
        x, _, c = self.grid()
        return np.interp(u, c, x)

    def quantile_column(self, u: Column) -> Column:
        """quantile() as an expression of the engine; null and NaN give null."""
        x, _, c = self.grid()
        return interpolated(u, c, x)

    def rvs(self, size=1, rng: np.random.Generator | None = None) -> np.ndarray:
        return self.quantile((rng or self.rng).random(size))

    def sample_latent_periods(self, size=1, rng: np.random.Generator | None = None) -> np.ndarray:
        return (rng or self.rng).gamma(self.parameters.latent_shape, self.parameters.incubation_scale, size)

    def sample_presymptomatic_periods(self, size=1, rng: np.random.Generator | None = None) -> np.ndarray:
        return (rng or self.rng).gamma(self.parameters.presymptomatic_shape, self.parameters.incubation_scale, size)

    def sample_incubation_periods(self, size=1, rng: np.random.Generator | None = None) -> np.ndarray:
        return self.sample_latent_periods(size, rng) + self.sample_presymptomatic_periods(size, rng)

    def sample_symptomatic_periods(self, size=1, rng: np.random.Generator | None = None) -> np.ndarray:
        return (rng or self.rng).gamma(self.parameters.symptomatic_shape, self.parameters.symptomatic_scale, size)

    def sample_testing_delays(self, size=1, rng: np.random.Generator | None = None) -> np.ndarray:
        return (rng or self.rng).gamma(self.parameters.testing_delay_shape, self.parameters.testing_delay_scale, size)

    def sample_clock_rate(self, size=1, rng: np.random.Generator | None = None) -> np.ndarray:
        """Mutations a day: lognormal around the median rate; that rate itself if relaxation is 0."""
        p = self.parameters
        return np.exp(p.relaxation * (rng or self.rng).standard_normal(size)) * p.mutations_per_day

    def expected_mutations(self, days, rng: np.random.Generator | None = None) -> np.ndarray:
        days = np.asarray(days, float)
        return days * self.sample_clock_rate(days.shape, rng)


class FromInfectiousness(TransmissionProfile):
    """Days from the onset of infectiousness to transmission."""

    def __init__(self, parameters: NaturalHistory | None = None, grid_min_days: float = 0.0, grid_max_days: float = 100.0, rng: np.random.Generator | None = None, rng_seed: int | None = None, integration_grid_points: int = 2048, sampling_grid_points: int = 1024) -> None:
        super().__init__(parameters, grid_min_days, grid_max_days, rng, rng_seed, sampling_grid_points)
        if integration_grid_points < 2:
            raise ConfigurationError("integration_grid_points must be 2 or more")
        self.integration_grid_points = integration_grid_points

    def sample_generation_intervals(self, size=1, rng: np.random.Generator | None = None) -> np.ndarray:
        """Latent period and time from infectiousness to transmission."""
        return self.sample_latent_periods(size, rng) + self.rvs(size, rng)

    def pdf(self, days) -> np.ndarray:
        """C * (ratio * P(still presymptomatic) + P(onset has come, still infectious)); 0 before day 0."""
        p = self.parameters
        y = np.atleast_1d(np.asarray(days, float))
        top = max(float(y.max(initial=0)), 1e-9)
        z = np.linspace(0, top, self.integration_grid_points)
        onset = gamma_pdf(z, p.presymptomatic_shape, p.incubation_scale)
        # survival of the symptomatic period, tabled once; a straight line between its points is right to about 1e-8
        fine = np.linspace(0, top, 1 << 16)
        survival = 1 - gamma_cdf(fine, p.symptomatic_shape, p.symptomatic_scale)
        lasting = (lambda x: np.exp(-x / p.symptomatic_scale)) if p.symptomatic_shape == 1 else (lambda x: np.interp(x, fine, survival))
        out = np.zeros(y.shape)
        for i in np.flatnonzero(y >= 0):
            after = 0.0
            if y[i] > 0:
                w = z * (y[i] / top)
                f = onset if y[i] == top else gamma_pdf(w, p.presymptomatic_shape, p.incubation_scale)
                after = np.trapezoid(lasting(y[i] - w) * f, w)
            before = p.transmission_rate_ratio * (1 - gamma_cdf(y[i], p.presymptomatic_shape, p.incubation_scale))
            out[i] = p.infectiousness_normalisation * (before + after)
        return out.reshape(np.shape(days))


class FromSymptomOnset(TransmissionProfile):
    """Days from symptom onset to transmission; negative before onset."""

    def __init__(self, parameters: NaturalHistory | None = None, grid_min_days: float = -30.0, grid_max_days: float = 30.0, rng: np.random.Generator | None = None, rng_seed: int | None = None, grid_points: int = 2048) -> None:
        super().__init__(parameters, grid_min_days, grid_max_days, rng, rng_seed, grid_points)

    def pdf(self, days) -> np.ndarray:
        p = self.parameters
        x = np.asarray(days, float)
        before = p.transmission_rate_ratio * (1 - gamma_cdf(-x, p.presymptomatic_shape, p.incubation_scale))
        after = 1 - gamma_cdf(x, p.symptomatic_shape, p.symptomatic_scale)
        return np.maximum(p.infectiousness_normalisation * np.where(x < 0, before, after), 0)
