"""Parameter and filter files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.plans.delineation import Parameters


def parameter_values(lines: list[str]) -> list[str]:
    """What follows the first colon of each line that has one."""
    return [line.partition(":")[2].strip() for line in lines if ":" in line]


def parse_parameters(lines: list[str]) -> Parameters:
    """From 14 lines in their fixed order."""
    v = parameter_values(lines)
    if len(v) < 14:
        raise ValueError(f"a parameter file has 14 values, this one {len(v)}")
    names = () if v[9] == "#" else tuple(n.strip() for n in v[9].split(","))
    return Parameters(
        block_coverage=int(v[0]), global_coverage=float(v[1]), least_footprint=float(v[2]), least_buildings=int(v[3]), least_patch=int(v[4]), largest_hole=int(v[5]), largest_gap=int(v[6]),
        first_partition=int(v[7]), last_partition=int(v[8]), partitions=names, log_level=v[10], epsg=int(v[11]), workspace=v[12], reset=v[13] == "True",
    )


def parse_codes(lines: list[str]) -> tuple[list[str], list[str]]:
    """(positive, negative) codes: the first 10 characters of lines in the first and second section; a section begins with a line of #. Blank lines and repeats are left out."""
    sections: dict[int, list[str]] = {1: [], 2: []}
    section = 0
    for line in lines:
        if line.startswith("#"):
            section += 1
        elif line.strip() and section in sections and line[:10].strip() not in sections[section]:
            sections[section].append(line[:10].strip())
    return sections[1], sections[2]


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Of a small text file, in order, wherever Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0].splitlines()


def read_parameters(spark: SparkSession, path: str) -> Parameters:
    return parse_parameters(read_lines(spark, path))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """code, polarity (POS or NEG)."""
    pos, neg = parse_codes(read_lines(spark, path))
    return spark.createDataFrame([(c, "POS") for c in pos] + [(c, "NEG") for c in neg], "code string, polarity string").select(F.col("code"), F.col("polarity"))
