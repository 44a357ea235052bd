"""Errors of this library."""


class ContagraphError(Exception):
    """Base of all."""


class ScenarioError(ContagraphError, ValueError):
    """A scenario label or target that can't be used."""


class ConfigurationError(ContagraphError, ValueError):
    """An argument outside its range."""


class SimulationError(ContagraphError, RuntimeError):
    """Draws or an outbreak that couldn't be made."""
