"""Whole runs by a settings file: reconstruction with a warm-up, line integrals and attenuation factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import POTENTIALS
from ..operators.geometry import grid
from ..operators.project import with_factors
from ..sources import raw, sinks
from . import recon
from .config import PENALTIES, Settings, SettingsError
from .log import timed


def load_events(spark: SparkSession, settings: Settings, suffix: str = ".lm") -> DataFrame:
    """Events with their factors; absent factor files are 0 and 1."""
    if settings.get("input_raw_data_format_type", [-1])[0] != 0:
        raise SettingsError("only list-mode data is supported")
    prefix = settings.values["input_raw_data_file"][0]
    events = raw.read_events(spark, prefix, suffix)
    return with_factors(events, raw.read_factor(spark, f"{prefix}.add_fac", "add_fac"), raw.read_factor(spark, f"{prefix}.mul_fac", "mul_fac"))


def _volume(spark: SparkSession, settings: Settings, key: str, missing: float = 1.0) -> DataFrame:
    path = settings.get(key, [""])[0]
    return raw.read_volume(spark, path, settings.scanner, missing) if path else grid(spark, settings.scanner).select("vox", F.lit(missing).alias("val"))


def penalty(spark: SparkSession, settings: Settings):
    """The penalty's surrogate as a function of an image, with the spatial weight if there is one; by default quadratic over the faces. The other potentials need a parameter."""
    kind = settings.get("regularizer_model_type", [-1])[0]
    if kind not in PENALTIES:
        raise SettingsError(f"no penalty {kind}")
    name = POTENTIALS[settings.get("regularizer_potential_function_type", [0])[0]]
    parameters = settings.get("regularizer_buildin_parameter_list", [])
    if name != "quad" and not parameters:
        raise SettingsError(f"{name} needs a parameter in regularizer_buildin_parameter_list")
    delta = parameters[0] if parameters else 1.0
    size, isotropic = settings.get("regularizer_neighborhood_properties", [0, 0])[:2]
    make = recon.mrf if PENALTIES[kind] == "mrf" else recon.patch
    plain = make(settings.scanner, name, delta, size, bool(isotropic))
    path = settings.get("regularizer_spatial_variant_weight", [""])[0]
    if not path:
        return plain
    kappa = raw.read_volume(spark, path, settings.scanner, 1.0).withColumnRenamed("val", "kappa")
    return lambda x: plain(x.join(kappa, "vox"))


def problem(spark: SparkSession, settings: Settings, events: DataFrame, subsets: int, beta: float = 0.0, **options) -> recon.Problem:
    trans, axial = settings.get("iPSF_model", [None, None])[:2]
    read = lambda path: raw.read_sparse(spark, path).withColumn("val", F.col("val").cast("double")) if path else None
    tracer = "tof" if settings.scanner.tof_fwhm_ps > 0 else "siddon"
    return recon.Problem(events, settings.scanner, subsets, tracer, read(trans), read(axial), _volume(spark, settings, "sensitivity"), beta, penalty(spark, settings) if beta > 0 else None, **options)


def _outputs(folder: str | None, step: int, projections: bool, phase: str = "main") -> recon.Outputs:
    if not folder:
        return recon.Outputs()
    return recon.Outputs(
        step, lambda n, x: sinks.write_image(x, folder, "intermediate", n), lambda n, x: sinks.write_image(x, folder, "intermediate_alpha", n),
        (lambda n, m, rows: sinks.write_projection(rows, folder, n, m, phase, None)) if projections else None,
    )


def reconstruct(spark: SparkSession, settings: Settings, folder: str | None = None, projections: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The image, and the likelihoods by phase, iteration and subset; with folder, both and the images between are written there.

    projections: also each subset's line integrals, without and with the background; they take another pass of its events.
    """
    with timed("reading"):
        events, x = load_events(spark, settings), _volume(spark, settings, "initial_guess")
    logs: list = []
    warm = settings.get("warmup_setting")
    if warm and warm[0] > 0 and warm[1] > 0:
        with timed("warm-up"):
            p = problem(spark, settings, events, warm[0], log=logs)
            x = recon.em(p, x, warm[1], _outputs(folder, 0, projections, "warmup"), "warmup")
            if folder:
                sinks.write_image(x, folder, "warmup")
    subsets, step, iterations = settings.get("iteration_setting", [1, 0, 1])[:3]
    beta, outputs = settings.get("regularizer_strength", [0.0])[0], _outputs(folder, step, projections)
    with timed(settings.algorithm):
        if settings.algorithm == "em":
            x = recon.em(problem(spark, settings, events, subsets, beta, log=logs), x, iterations, outputs)
        elif settings.algorithm == "kem":
            matrix = settings.get("kernel_matrix")
            if not matrix:
                raise SettingsError("kernel EM needs kernel_matrix")
            x = recon.kem(problem(spark, settings, events, subsets, log=logs), raw.read_sparse(spark, matrix[0]), x, iterations, outputs)
        else:
            x = recon.admm(problem(spark, settings, events, subsets, log=logs), x, iterations, penalty(spark, settings), beta, outputs=outputs)
    rows = recon.likelihoods(logs)
    if folder:
        sinks.write_image(x, folder, "image")
        if rows is not None:
            sinks.write_likelihood(rows, folder)
    return x, rows


def line_section(spark: SparkSession, settings: Settings, folder: str) -> DataFrame:
    """A reconstruction by EM or ADMM whose image is also written as a headerless file, <folder>/<prefix>.img."""
    if settings.algorithm == "kem":
        raise SettingsError("kernel EM has no line section run")
    x, _ = reconstruct(spark, settings, folder)
    raw.write_raw(x, f"{folder}/{settings.get('reconstruction_output_setting', ['', 'image'])[1]}.img", "vox")
    return x


def lines(spark: SparkSession, settings: Settings, exponential: bool = False, suffix: str = "", folder: str | None = None) -> DataFrame:
    """Line integrals of the initial guess (or attenuation factors, exp(-y)) for the warm-up's first subset; the events' file has no suffix."""
    p = problem(spark, settings, load_events(spark, settings, suffix), settings.warmup_subsets)
    out = recon.line_integrals(p, _volume(spark, settings, "initial_guess"), exponential)
    if folder:
        place = out.withColumn("pos", F.expr(f"event_id div {p.subsets}"))
        raw.write_raw(place, f"{folder}/{settings.get('reconstruction_output_setting', ['', 'lines'])[1]}", "pos", "factor" if exponential else "y")
    return out
