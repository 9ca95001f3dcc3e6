"""Typed failures; callers tell families apart by class."""


class EngineError(ValueError):
    """Base of all failures that the engine raises on purpose."""


class ConfigError(EngineError):
    """Settings that cannot be parsed or contradict each other."""


class SourceError(EngineError):
    """A file or table of the wrong shape, format or georeference."""


class CorrectionError(EngineError):
    """Delay or geometry layers that are missing, misplaced or incomplete."""


class BoundsError(EngineError):
    """An area of interest that is invalid, empty, too small or not covered."""


class StitchError(EngineError):
    """Too few shared pixels to join two bursts."""

    def __init__(self, burst: int, epoch: int, found: int, required: int) -> None:
        super().__init__(f"burst {burst}, epoch {epoch}: {found} shared pixels, {required} needed")
        self.burst, self.epoch, self.found, self.required = burst, epoch, found, required


class UnwrapError(EngineError):
    """Inputs that cannot be unwrapped, or a solver that is not available."""
