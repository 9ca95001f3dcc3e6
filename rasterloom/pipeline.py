"""A displacement run end to end: link, choose a reference, unwrap, check loops, invert, fit rates, scale, write.

Every step is an operator on tables; only a reference pixel and a few numbers an epoch reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.config import UNSUPPORTED, Workflow
from rasterloom.errors import ConfigError, UnwrapError
from rasterloom.kernels import linking as k
from rasterloom.kernels import sequential, series
from rasterloom.operators import inversion, linking, mosaic, stack, unwrapping
from rasterloom.plans.blocks import Grid, step_days
from rasterloom.session import written
from rasterloom.sources.rasters import write_outputs

PLANS = {"always_first": "always_first", "first_per_ministack": "first_per", "last_per_ministack": "last_per"}
DEFAULT_WAVELENGTH = 0.05546576


@dataclass
class Products:
    """Layers by name, the reference pixel and the pairs of the network."""

    layers: dict[str, DataFrame]
    reference: tuple[int, int]
    pairs: list[tuple[int, int]] = field(default_factory=list)


def network(cfg: Workflow, days: list[float]) -> list[tuple[int, int]]:
    """Pairs of all generators that are set, sorted and distinct; every date against the first if none is."""
    net, n = cfg.interferogram_network.resolved(), len(days)
    pairs: set[tuple[int, int]] = set()
    if net.reference_idx is not None:
        pairs |= {(min(net.reference_idx, j), max(net.reference_idx, j)) for j in range(n) if j != net.reference_idx}
    if net.max_bandwidth is not None:
        pairs |= {(i, j) for i in range(n) for j in range(i + 1, min(i + net.max_bandwidth, n - 1) + 1)}
    if net.max_temporal_baseline is not None:
        pairs |= {(i, j) for i in range(n) for j in range(i + 1, n) if days[j] - days[i] <= net.max_temporal_baseline}
    for i, j in net.indexes or []:
        i, j = i % n, j % n
        pairs.add((min(i, j), max(i, j)))
    return sorted(pairs)


def settings(cfg: Workflow) -> tuple[sequential.Plan, k.Linking]:
    p = cfg.phase_linking
    plan = sequential.Plan(p.ministack_size, p.max_num_compressed, PLANS[p.compressed_slc_plan], p.output_reference_idx or 0)
    how = k.Linking(p.half_window.rows_cols(), (1, 1), "evd" if p.use_evd else "emi", p.beta, p.zero_correlation_threshold, p.shp_method, p.shp_alpha, True, p.write_closure_phase, p.calc_average_coh)
    return plan, how


def validate(cfg: Workflow, epochs: int) -> None:
    """Refuse what cannot be run before any job starts."""
    t = cfg.timeseries_options
    series.check_uncertainty_options(t.method, t.write_posterior_uncertainty, t.write_velocity_uncertainty, cfg.phase_linking.write_crlb, t.correct_velocity_temporal_correlation)
    if cfg.unwrap_options.unwrap_method in UNSUPPORTED:
        raise UnwrapError(f"unwrapping by {cfg.unwrap_options.unwrap_method} is not supported; use native or tophu")
    if cfg.output_options.strides.rows_cols() != (1, 1):
        raise ConfigError("linking of tiles runs at full resolution")
    if epochs < 2:
        raise ConfigError("a series needs two epochs")


def link(samples: DataFrame, epochs: int, cfg: Workflow, shape: tuple[int, int] | None = None) -> DataFrame:
    plan, how = settings(cfg)
    return written(linking.link_sequential(samples, epochs, plan, how, shape=shape), "linked-phases")


def unwrap(linked: DataFrame, pairs: list[tuple[int, int]], cfg: Workflow, shape: tuple[int, int], mask: DataFrame | None = None) -> DataFrame:
    """``(ifg, row, col, phase)`` of the network with the linked quality as coherence; masked pixels have phase 0 of no coherence."""
    theta = linked.groupBy("row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "phase"))), lambda x: x["phase"]).alias("theta"), F.first("temp_coh").alias("quality"))
    corr = mosaic.analysis_correlation(theta.select("row", "col", "quality"), mask if cfg.unwrap_options.zero_where_masked else None)
    ifgs = unwrapping.form_network(theta, pairs).join(corr, ["row", "col"])
    if mask is not None:
        ifgs = ifgs.join(mask, ["row", "col"], "left").withColumn("psi", F.when(F.col("keep") == 0, 0.0).otherwise(F.col("psi"))).drop("keep")
    if cfg.unwrap_options.unwrap_method == "tophu":
        o = cfg.unwrap_options.tophu_options
        return unwrapping.multiscale(ifgs, shape, tuple(o.downsample_factor), tuple(o.ntiles)).withColumnRenamed("unwrapped", "phase")
    return unwrapping.unwrap_network(ifgs, shape).withColumnRenamed("unwrapped", "phase")


def run(samples: DataFrame, days: list[float], cfg: Workflow = Workflow(), first_day=None, mask: DataFrame | None = None, shape: tuple[int, int] | None = None) -> Products:
    """All layers of a run over ``(row, col, z)`` with one sample pair an epoch."""
    epochs = len(days)
    validate(cfg, epochs)
    shape = shape or stack.grid_shape(samples)
    return finish(link(samples, epochs, cfg, shape), days, cfg, shape, first_day, mask)


def finish(linked: DataFrame, days: list[float], cfg: Workflow, shape: tuple[int, int], first_day=None, mask: DataFrame | None = None) -> Products:
    """Everything after linking; an updated series enters here."""
    t, pairs = cfg.timeseries_options, network(cfg, days)
    quality = linked.groupBy("row", "col").agg(F.first("temp_coh").alias("quality"))
    ifgs = written(unwrap(linked, pairs, cfg, shape, mask), "unwrapped-network")
    if t.reference_point:
        reference = tuple(t.reference_point)
    else:
        found = inversion.reference_point(quality, t.correlation_threshold).first()
        if found is None:
            raise ConfigError("no pixel exceeds the correlation threshold")
        reference = (found["row"], found["col"])
    base = ifgs.where((F.col("row") == reference[0]) & (F.col("col") == reference[1])).select("ifg", F.col("phase").alias("base"))
    ifgs = ifgs.join(F.broadcast(base), "ifg").withColumn("phase", F.when(~F.isnan("base"), F.col("phase") - F.col("base")).otherwise(F.col("phase"))).drop("base")  # one row a pair is broadcast
    qc = inversion.loop_qc(ifgs.select("ifg", "row", "col", "phase"), pairs) if series.triplets(pairs) else None
    if qc is not None and t.mask_unwrap_loop_errors:
        ifgs = inversion.loop_mask(ifgs, qc)
    sigma = linked.groupBy("row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "sigma"))), lambda x: x["sigma"]).alias("sigma"))
    weights = inversion.precisions(sigma, pairs)
    pixels = inversion.by_pixel(ifgs, len(pairs), "phase")
    weighted = t.use_coherence_weights and t.method == "L2"
    if weighted:
        pixels = pixels.join(weights.select("row", "col", F.col("by_pair").alias("w")), ["row", "col"])
    solved = written(inversion.invert(pixels, pairs, t.method.lower(), "w" if weighted else None), "inverted-series")
    full = solved.join(weights.select("row", "col", "valid", "by_date"), ["row", "col"]).select("row", "col", F.concat(F.array(F.lit(0.0)), F.col("series")).alias("series"), "by_date", "valid", "variance", "rms")
    model = series.VelocityModel(t.velocity_seasonal, step_days(t.velocity_step_dates, first_day) if t.velocity_step_dates else ())
    rates = inversion.velocities(full, days, model, "by_date" if t.write_velocity_uncertainty else None)
    if t.correct_velocity_temporal_correlation:
        rates = rates.withColumn("sigma", F.col("sigma") * F.col("inflation"))
    k_m = -(cfg.input_options.wavelength or DEFAULT_WAVELENGTH) / (4 * math.pi)
    cube = full.select("row", "col", F.posexplode("series").alias("epoch", "value"))
    valid = full.select("row", "col", "valid")
    layers = {
        "displacement": mosaic.validity(cube.select("row", "col", "epoch", (F.col("value") * k_m).alias("value")), valid.withColumn("valid", F.lit(True)), rates.select("row", "col", "velocity"), ["value"]),
        "velocity": rates.select("row", "col", (F.col("velocity") * k_m).alias("value")),
        "temporal_coherence": quality.select("row", "col", F.col("quality").alias("value")),
        "timeseries_residual": full.select("row", "col", F.abs(F.col("rms") * k_m).alias("value")),
    }
    for name in rates.columns[2:]:
        if name.startswith(("seasonal_amplitude", "step_")):
            layers[name] = rates.select("row", "col", (F.col(name) * (abs(k_m) if name.startswith("seasonal") else k_m)).alias("value"))
        elif name == "seasonal_peak_day":
            layers[name] = rates.select("row", "col", F.col(name).alias("value"))
    if cfg.phase_linking.write_crlb:
        layers["crlb_sigma"] = linked.select("row", "col", "epoch", F.col("sigma").alias("value"))
    if t.write_velocity_uncertainty:
        layers["velocity_sigma"] = inversion.clear_unbounded(rates.select("row", "col", F.abs(F.col("sigma") * k_m).alias("value")), valid, "value")
    if t.write_posterior_uncertainty:
        long = full.select("row", "col", F.posexplode("variance").alias("epoch", "variance")).withColumn("epoch", F.col("epoch") + 1)
        layers["posterior_variance"] = inversion.reference_variance(long, reference).select("row", "col", "epoch", (F.col("variance") * k_m**2).alias("value"))
    if qc is not None:
        layers["loop_failures"] = qc.select("row", "col", F.col("bad").alias("value"))
    return Products(layers, reference, pairs)


def emit(products: Products, path: str, grid: Grid | None = None, everything: bool = True) -> None:
    """Write all layers, or the temporal coherence alone."""
    names = list(products.layers) if everything else ["temporal_coherence"]
    write_outputs({n: products.layers[n] for n in names}, path, grid, {"reference": f"{products.reference[0]},{products.reference[1]}"})
