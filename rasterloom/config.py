"""Settings of a run as dataclasses; YAML in and out, missing keys have defaults and unknown ones are ignored."""

from __future__ import annotations

import dataclasses
import types
import typing
from dataclasses import dataclass, field

import yaml

from rasterloom.errors import ConfigError


@dataclass
class Pair:
    x: int = 1
    y: int = 1

    def rows_cols(self) -> tuple[int, int]:
        return self.y, self.x


@dataclass
class InputOptions:
    input_type: str = "opera_cslc"
    subdataset: str | None = None
    cslc_date_fmt: str = "%Y%m%d"
    wavelength: float | None = None


@dataclass
class OutputOptions:
    strides: Pair = field(default_factory=Pair)
    epsg: int | None = None
    bounds: list[float] | None = None
    bounds_epsg: int = 4326
    add_overviews: bool = True
    overview_levels: list[int] = field(default_factory=lambda: [4, 8, 16, 32, 64])


@dataclass
class PsOptions:
    amp_dispersion_threshold: float = 0.25


@dataclass
class PhaseLinking:
    ministack_size: int = 15
    max_num_compressed: int = 10
    output_reference_idx: int | None = None
    half_window: Pair = field(default_factory=lambda: Pair(14, 7))
    use_evd: bool = False
    beta: float = 0.0
    zero_correlation_threshold: float = 0.0
    shp_method: str = "glrt"
    shp_alpha: float = 0.001
    compressed_slc_plan: str = "always_first"
    write_crlb: bool = True
    write_closure_phase: bool = False
    calc_average_coh: bool = False
    correct_phase_bias: bool = False


@dataclass
class InterferogramNetwork:
    reference_idx: int | None = None
    max_bandwidth: int | None = None
    max_temporal_baseline: float | None = None
    indexes: list[list[int]] | None = None

    def resolved(self) -> InterferogramNetwork:
        """With nothing set the network is every date against the first."""
        empty = all(getattr(self, f.name) is None for f in dataclasses.fields(self))
        return dataclasses.replace(self, reference_idx=0) if empty else self


@dataclass
class TimeseriesOptions:
    method: str = "L1"
    reference_point: list[int] | None = None
    correlation_threshold: float = 0.2
    use_coherence_weights: bool = True
    write_posterior_uncertainty: bool = False
    write_velocity_uncertainty: bool = False
    correct_velocity_temporal_correlation: bool = False
    velocity_seasonal: bool = False
    velocity_step_dates: list[str] = field(default_factory=list)
    mask_unwrap_loop_errors: bool = False


@dataclass
class SnaphuOptions:
    ntiles: list[int] = field(default_factory=lambda: [1, 1])
    tile_overlap: list[int] = field(default_factory=lambda: [0, 0])
    n_parallel_tiles: int = 1
    init: str = "mcf"
    cost: str = "smooth"
    auto_tile: bool = False


@dataclass
class TophuOptions:
    ntiles: list[int] = field(default_factory=lambda: [1, 1])
    downsample_factor: list[int] = field(default_factory=lambda: [1, 1])
    init: str = "mcf"
    cost: str = "smooth"


@dataclass
class UnwrapOptions:
    unwrap_method: str = "native"
    n_parallel_jobs: int = -1
    zero_where_masked: bool = False
    run_interpolation: bool = False
    snaphu_options: SnaphuOptions = field(default_factory=SnaphuOptions)
    tophu_options: TophuOptions = field(default_factory=TophuOptions)


@dataclass
class CorrectionOptions:
    ionosphere_files: list[str] = field(default_factory=list)
    troposphere_files: list[str] = field(default_factory=list)
    geometry_files: list[str] = field(default_factory=list)
    dem_file: str | None = None
    incidence_angle_deg: float = 37.0
    troposphere_variable: str = "total"
    solid_earth_tide: bool = False


@dataclass
class WorkerSettings:
    compute_backend: str = "cpu"
    block_shape: list[int] = field(default_factory=lambda: [512, 512])


@dataclass
class Workflow:
    input_options: InputOptions = field(default_factory=InputOptions)
    output_options: OutputOptions = field(default_factory=OutputOptions)
    ps_options: PsOptions = field(default_factory=PsOptions)
    phase_linking: PhaseLinking = field(default_factory=PhaseLinking)
    interferogram_network: InterferogramNetwork = field(default_factory=InterferogramNetwork)
    timeseries_options: TimeseriesOptions = field(default_factory=TimeseriesOptions)
    unwrap_options: UnwrapOptions = field(default_factory=UnwrapOptions)
    correction_options: CorrectionOptions = field(default_factory=CorrectionOptions)
    worker_settings: WorkerSettings = field(default_factory=WorkerSettings)
    cslc_file_list: list[str] = field(default_factory=list)
    mask_file: str | None = None
    work_directory: str = "."


# fixed values: what the settings accept
CHOICES = {
    ("PhaseLinking", "shp_method"): ("glrt", "ks", "rect"), ("PhaseLinking", "compressed_slc_plan"): ("always_first", "first_per_ministack", "last_per_ministack"),
    ("UnwrapOptions", "unwrap_method"): ("native", "snaphu", "tophu", "icu", "phass", "spurt", "whirlwind"), ("TimeseriesOptions", "method"): ("L1", "L2"),
    ("InputOptions", "input_type"): ("opera_cslc", "nisar_gslc", "nisar_rslc"), ("WorkerSettings", "compute_backend"): ("cpu", "auto", "gpu"),
}
UNSUPPORTED = {"snaphu", "icu", "phass", "spurt", "whirlwind"}


def _read(kind, value, where: str):
    if dataclasses.is_dataclass(kind):
        value = {} if value is None else value
        if not isinstance(value, dict):
            raise ConfigError(f"{where}: expected keys and values")
        hints = typing.get_type_hints(kind)
        return kind(**{f.name: _read(hints[f.name], value[f.name], f"{where}.{f.name}".lstrip(".")) for f in dataclasses.fields(kind) if f.name in value})
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (types.UnionType, typing.Union):
        return None if value is None else _read(args[0], value, where)
    if origin is list:
        if not isinstance(value, (list, tuple)):
            raise ConfigError(f"{where}: expected a list")
        return [_read(args[0], v, where) for v in value]
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if kind is str and value is not None and not isinstance(value, (dict, list)):
        return str(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise ConfigError(f"{where}: expected {kind.__name__}, found {value!r}")
    return value


def _check(settings, name: str = "") -> None:
    for f in dataclasses.fields(settings):
        value = getattr(settings, f.name)
        if dataclasses.is_dataclass(value):
            _check(value, f.name)
        known = CHOICES.get((type(settings).__name__, f.name))
        if known and value not in known:
            raise ConfigError(f"{name}.{f.name}: {value!r} is none of {', '.join(known)}")


def parse(text: str) -> Workflow:
    try:
        tree = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from e
    found = _read(Workflow, tree or {}, "")
    _check(found)
    if found.unwrap_options.run_interpolation:
        raise ConfigError("interpolation before unwrapping is not supported")
    return found


def dump(settings: Workflow) -> str:
    return yaml.safe_dump(dataclasses.asdict(settings), sort_keys=False)
