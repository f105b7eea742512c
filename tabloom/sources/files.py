"""Sources and sinks: text lines, delimited records, annotated training files, model folders and archives."""

from __future__ import annotations

import json
import tarfile
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.errors import ParameterError, UserError
from tabloom.operators.sequences import numbered


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, line): lines numbered from 0 by file and place; invalid bytes become replacement characters."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    return numbered(rows, ["file", "at"], "line_id").select("line_id", "line")


def first_lines(lines: DataFrame, n: int | None) -> DataFrame:
    return lines if not n else lines.orderBy("line_id").limit(n)


def write_records(df: DataFrame, path: str, delimiter: str = ",", columns: Sequence[str] | None = None) -> None:
    """Delimited text without a header, missing values empty."""
    df.select(*(columns or df.columns)).na.fill("").write.mode("overwrite").csv(path, sep=delimiter, header=False, emptyValue="", nullValue="")


def write_annotated(lines: DataFrame, annotate: Column, path: str) -> None:
    lines.select(F.regexp_replace(annotate, "\n$", "").alias("value")).write.mode("overwrite").text(path)


def write_generated(lines: DataFrame, path: str, batch_mode: bool) -> None:
    """Accepted lines: with column batches as CSV with a header, otherwise as plain text."""
    good = lines.where(F.coalesce("valid", F.lit(True)))
    if batch_mode:
        good.drop("valid", "explain", "values").write.mode("overwrite").csv(path, header=True)
    else:
        good.select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def typed(lines: DataFrame, text: str, headers: Sequence[str], delimiter: str = ",", schema: str | None = None) -> DataFrame:
    """Records of delimited lines as columns in the given order; types inferred unless a schema is given; no lines: no rows."""
    spark = lines.sparkSession
    if lines.isEmpty():
        return spark.createDataFrame([], ", ".join(f"`{h}` string" for h in headers))
    plain = lines.select(F.col(text).alias("value"))
    if schema is None:
        path_free = plain.select(F.from_csv("value", ", ".join(f"`{h}` string" for h in headers), {"sep": delimiter}).alias("r")).select("r.*")
        kinds = path_free.agg(*[F.struct((F.count(f"`{h}`") == F.count(F.col(f"`{h}`").try_cast("bigint"))).alias("i"), (F.count(f"`{h}`") == F.count(F.col(f"`{h}`").try_cast("double"))).alias("d")).alias(h) for h in headers]).first()
        return path_free.select(*[F.col(f"`{h}`").cast("bigint" if kinds[h]["i"] else "double" if kinds[h]["d"] else "string").alias(h) for h in headers])
    return plain.select(F.from_csv("value", schema, {"sep": delimiter}).alias("r")).select("r.*")


# ---------------------------------------------------------------- model folders (driver side)


@dataclass
class BatchConfig:
    """What a column batch needs to be trained and generated again."""

    checkpoint_dir: str
    input_data_path: str = ""
    field_delimiter: str = ","
    max_lines: int = 0
    vocab_size: int = 20_000
    epochs: int = 100
    batch_size: int = 64
    learning_rate: float = 0.01
    gen_lines: int = 1000
    max_invalid: int = 1000
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.checkpoint_dir:
            raise ParameterError("checkpoint_dir is required")
        for name in ("epochs", "batch_size", "gen_lines"):
            if getattr(self, name) <= 0:
                raise ParameterError(f"{name} is positive")

    def save(self) -> Path:
        path = Path(self.checkpoint_dir)
        path.mkdir(parents=True, exist_ok=True)
        (path / "model_params.json").write_text(json.dumps(asdict(self), indent=1))
        return path / "model_params.json"

    @classmethod
    def load(cls, folder: str) -> BatchConfig:
        """Also reads older files: an absent learning rate is 0.01, or their private-training rate where that was on."""
        raw = json.loads((Path(folder) / "model_params.json").read_text())
        if "learning_rate" not in raw:
            raw["learning_rate"] = raw.get("dp_learning_rate", 0.001) if raw.get("dp") else 0.01
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        known.setdefault("checkpoint_dir", folder)
        known["extra"] = {**known.get("extra", {}), **{k: v for k, v in raw.items() if k not in cls.__dataclass_fields__}}
        return cls(**known)


def save_headers(folder: str, headers: Sequence[str], original: bool = False) -> None:
    (Path(folder) / ("original_headers.json" if original else "headers.json")).write_text(json.dumps(list(headers)))


def load_headers(folder: str, original: bool = False) -> list[str]:
    return json.loads((Path(folder) / ("original_headers.json" if original else "headers.json")).read_text())


def batch_folders(folder: str) -> list[Path]:
    """Folders batch_0, batch_1, ... in order of their number."""
    found = sorted((p for p in Path(folder).glob("batch_*") if p.name[6:].isdigit()), key=lambda p: int(p.name[6:]))
    if not found:
        raise UserError(f"no batches in {folder}")
    return found


def is_batched(folder: str) -> bool:
    return any(p.name.startswith("batch_") for p in Path(folder).iterdir())


def archive(folder: str, target: str) -> None:
    """A tar.gz of the files of a model folder, data files left out."""
    with tarfile.open(target, "w:gz") as tar:
        for p in sorted(Path(folder).rglob("*")):
            if p.is_file() and p.suffix not in (".csv", ".txt"):
                tar.add(p, p.relative_to(folder))


def extract(source: str, folder: str) -> None:
    """Unpacks an archive; a member that would land outside the folder is an error before anything is written."""
    root = Path(folder).resolve()
    with tarfile.open(source) as tar:
        for m in tar.getmembers():
            if not (root / m.name).resolve().is_relative_to(root):
                raise UserError(f"{m.name} would land outside {folder}")
        tar.extractall(root, filter="data")
