"""Settings files: lines `key = v1, v2` with # comments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scanner import Scanner

#: The keys that a settings file may have, and those it must have.
KEYS = [
    "image_size", "voxel_size", "detector_ring_diameter", "crystal_size", "crystal_array_size", "crystal_gap_size", "number_of_detector_modules", "DOI_information",
    "detector_module_angular_offset", "detector_module_axial_offsets", "initial_guess", "reconstruction_output_setting", "sensitivity", "TOF_information", "iPSF_model",
    "regularizer_strength", "regularizer_model_type", "regularizer_potential_function_type", "regularizer_neighborhood_properties", "regularizer_buildin_parameter_list",
    "regularizer_spatial_variant_weight", "warmup_setting", "iteration_setting", "iterative_algorithm_type", "input_raw_data_file", "input_raw_data_format_type",
    "number_of_radial_bins", "kernel_matrix", "gb_alpha", "gb_CIP",
]
MANDATORY = ["image_size", "voxel_size", "detector_ring_diameter", "crystal_size", "crystal_array_size", "number_of_detector_modules"]
#: For each typed key: type, least number of values, and the least value with whether it is allowed itself.
TYPES = {
    "image_size": (int, 3, 0, False), "voxel_size": (float, 3, 0, False), "detector_ring_diameter": (float, 1, 0, True), "crystal_size": (float, 4, 0, True),
    "crystal_array_size": (int, 2, 0, False), "crystal_gap_size": (float, 3, 0, True), "number_of_detector_modules": (int, 2, 0, False), "DOI_information": (float, 2, 0, False),
    "detector_module_angular_offset": (float, 1, None, True), "initial_guess": (str, 1, None, True), "reconstruction_output_setting": (str, 2, None, True), "sensitivity": (str, 1, None, True),
    "TOF_information": (float, 2, 0, False), "iPSF_model": (str, 2, None, True), "regularizer_strength": (float, 1, 0, True), "regularizer_model_type": (int, 1, None, True),
    "regularizer_potential_function_type": (int, 1, 0, True), "regularizer_neighborhood_properties": (int, 2, 0, True), "regularizer_buildin_parameter_list": (float, 1, None, True),
    "regularizer_spatial_variant_weight": (str, 1, None, True), "warmup_setting": (int, 2, None, True), "iteration_setting": (int, 3, None, True), "iterative_algorithm_type": (int, 1, None, True),
    "input_raw_data_file": (str, 1, None, True), "input_raw_data_format_type": (int, 1, None, True), "number_of_radial_bins": (int, 1, None, True), "kernel_matrix": (str, 1, None, True),
}
ALGORITHMS = {0: "em", 1: "admm", 2: "kem"}
PENALTIES = {0: "mrf", 1: "patch"}


class SettingsError(ValueError):
    pass


def split_list(text: str, by: str = ",") -> list[str]:
    """The parts of a list; one empty part at the end doesn't count."""
    parts = text.split(by)
    return parts[:-1] if parts and parts[-1] == "" else parts


def classify(lines: DataFrame) -> DataFrame:
    """lines has line and text; adds key, value and state: EMPTY, COMMENT, BAD (not one =, or nothing on a side), UNKNOWN or OK."""
    bare = F.regexp_replace(F.split("text", "#")[0], "[ \t\r\n\x08]", "")
    parts = F.split(bare, "=")
    rows = lines.withColumn("bare", bare).withColumn("parts", parts)
    key, value = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    comment = F.ltrim("text").startswith("#")
    state = F.when(comment, "COMMENT").when(F.col("bare") == "", "EMPTY").when((F.size("parts") != 2) | (key == "") | (value == ""), "BAD").when(~key.isin(KEYS), "UNKNOWN").otherwise("OK")
    rows = rows.withColumn("state", state)
    known = F.col("state").isin("OK", "UNKNOWN")
    return rows.select("line", "text", F.when(known, key).alias("key"), F.when(known, value).alias("value"), "state")


def problems(classified: DataFrame) -> DataFrame:
    """kind and key: each key that stands twice, and each mandatory key that is missing."""
    spark, good = classified.sparkSession, classified.where("state = 'OK'")
    twice = good.groupBy("key").count().where("count > 1").selectExpr("'duplicate' AS kind", "key")
    must = spark.createDataFrame([(k,) for k in MANDATORY], "key string")
    return twice.union(must.join(good.select("key"), "key", "left_anti").selectExpr("'missing' AS kind", "key"))


@dataclass
class Settings:
    """Values by key, and what follows from them. What is left out has its default here."""

    values: dict[str, list] = field(default_factory=dict)
    unknown: list[str] = field(default_factory=list)

    def get(self, key: str, default=None):
        return self.values.get(key, default)

    @property
    def scanner(self) -> Scanner:
        v = self.values
        ni, nj, nk = v["image_size"][:3]
        vi, vj, vk = v["voxel_size"][:3]
        if ni != nj or vi != vj:
            raise SettingsError("images must be square in the plane")
        front, _, axial, depth = v["crystal_size"][:4]
        gap = v.get("crystal_gap_size", [0.0, 0.0, 0.0])
        t, a = v["crystal_array_size"][:2]
        mt, ma = v["number_of_detector_modules"][:2]
        tof = v.get("TOF_information", [-1.0, -1.0])
        return Scanner(mt, t, a * ma, v["detector_ring_diameter"][0], depth, front + gap[0], axial + gap[2], ni, nk, vi, vk, bool(v.get("detector_module_angular_offset", [0.0])[0]), tof[0], tof[1])

    @property
    def subsets(self) -> int:
        return self.values["iteration_setting"][0] if "iteration_setting" in self.values else 1

    @property
    def warmup_subsets(self) -> int:
        """1 where there is no warm-up."""
        return max(1, self.values["warmup_setting"][0]) if "warmup_setting" in self.values else 1

    @property
    def algorithm(self) -> str:
        kind = self.values.get("iterative_algorithm_type", [-1])[0]
        if kind not in ALGORITHMS:
            raise SettingsError(f"no algorithm {kind}")
        return ALGORITHMS[kind]


def parse(text: str) -> Settings:
    """A whole settings file. Unknown keys are noted; a key that stands twice, a bad value and a missing mandatory key are errors."""
    out = Settings()
    for number, line in enumerate(text.splitlines(), 1):
        bare = re.sub("[ \t\r\n\x08]", "", line.split("#")[0])
        if not bare:
            continue
        parts = bare.split("=")
        if len(parts) != 2 or not all(parts):
            raise SettingsError(f"line {number}: {line!r}")
        key, value = parts
        if key not in KEYS:
            out.unknown.append(key)
        elif key in out.values:
            raise SettingsError(f"line {number}: {key} stands twice")
        else:
            out.values[key] = typed(key, value)
    if missing := [k for k in MANDATORY if k not in out.values]:
        raise SettingsError(f"missing: {', '.join(missing)}")
    return out


def typed(key: str, value: str) -> list:
    kind, n, least, equal = TYPES.get(key, (str, 1, None, True))
    parts = split_list(value)
    if len(parts) < n:
        raise SettingsError(f"{key} needs {n} values")
    try:
        got = [kind(x) for x in (parts if key == "regularizer_buildin_parameter_list" else parts[:n])]
    except ValueError as e:
        raise SettingsError(f"{key}: {value}") from e
    if least is not None and any(x < least or x == least and not equal for x in got):
        raise SettingsError(f"{key} must be more than {least}")
    if key == "regularizer_potential_function_type" and got[0] > 5:
        raise SettingsError("there are six potentials, 0 to 5")
    if key == "iteration_setting" and (got[0] <= 0 or got[2] <= 0):
        raise SettingsError("subsets and iterations must be positive")
    if key == "regularizer_buildin_parameter_list":
        got = [max(x, 0.0) for x in got]
    return got
