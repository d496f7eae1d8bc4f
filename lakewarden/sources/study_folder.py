"""Folders of dataset files. Of several forms of one dataset the first in ``ORDER`` is read."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Dataset, Study
from . import frame
from .dataset_json import read_dataset_json
from .define_xml import read_define, read_stf
from .json_rows import head
from .sas7bdat import read_sas7bdat
from .tables import read_csv
from .usdm import read_usdm
from .xpt import XptDataSource, head_of

ORDER = (".xpt", ".sas7bdat", ".json", ".ndjson", ".parquet", ".csv")


def read_xpt(spark: SparkSession, path: Path, name: str | None = None) -> Dataset:
    spark.dataSource.register(XptDataSource)
    member, label, fields, _ = head_of(str(path))
    out = frame.from_frame(spark.read.format("xpt").load(str(path)), name or member or path.stem, [v for v, _ in fields], label)
    out.file_size, out.file_name = path.stat().st_size, path.name
    return out


def read_file(spark: SparkSession, path: Path, name: str | None = None) -> Dataset:
    """One dataset file by its ending."""
    path = Path(path)
    kind = path.suffix.lower()
    if kind == ".xpt":
        return read_xpt(spark, path, name)
    if kind in (".json", ".ndjson"):
        return read_dataset_json(spark, path)
    if kind == ".parquet":
        return frame.parquet(spark, str(path), name or path.stem)
    if kind == ".csv":
        return read_csv(spark, path, name or path.stem)
    if kind == ".sas7bdat":
        return read_sas7bdat(spark, path, name)
    raise ValueError(f"no reader for {path.name}")


def _is_usdm(text: str) -> bool:
    """Told by keys, wherever they stand: ``usdmVersion`` often comes below the study object. A quoted word in a cell is no key."""
    if re.search(r'"datasetJSONVersion"\s*:', text):
        return False
    return re.search(r'"usdmVersion"\s*:|"study"\s*:\s*\{', text) is not None


def _holds_usdm(path: Path) -> bool:
    """A document with a list of rows is a dataset, and is read up to there."""
    text, rows = head(str(path))
    return not rows and _is_usdm(text.decode("utf-8", "replace"))


def read_folder(spark: SparkSession, folder: str | Path, entities: dict[str, str] | None = None) -> Study:
    folder = Path(folder)
    if not folder.is_dir():
        raise FileNotFoundError(f"no such folder: {folder}")
    files = sorted(folder.iterdir())
    documents = [p for p in files if p.suffix == ".json" and _holds_usdm(p)]
    if documents:
        if len(documents) > 1:
            raise ValueError("a folder must hold one USDM document")
        return read_usdm(spark, documents[0], entities)
    found: dict[str, Path] = {}
    for kind in ORDER:
        same = Counter(p.stem.upper() for p in files if p.suffix.lower() == kind)
        twice = [n for n, k in same.items() if k > 1]
        if twice:
            raise ValueError(f"more than one {kind} file for {', '.join(twice)}")
        for p in files:
            if p.suffix.lower() == kind and not p.name.startswith(("_", ".")):
                found.setdefault(p.stem.upper(), p)
    if not found:
        raise ValueError(f"no dataset file in {folder}")
    study = Study()
    for p in found.values():
        d = read_file(spark, p)
        study.datasets[d.name.upper()] = d
    for p in files:
        if p.name.lower() == "define.xml":
            study.define = read_define(p)
        elif p.name.lower() == "stf.xml":
            study.stf = read_stf(p)
    return study


def ct_package_of(study: Study) -> str | None:
    """The terminology release that TS cites most (of equals the newest), else the define's newest."""
    ts = study.get("TS")
    if ts and {"TSVCDREF", "TSVCDVER"} <= set(ts.columns):
        cited = ts.df.filter(F.upper(F.trim("TSVCDREF")).isin("CDISC", "CDISC CT") & (F.trim("TSVCDVER") != ""))
        top = cited.groupBy(F.trim("TSVCDVER").alias("v")).count().orderBy(F.desc("count"), F.desc("v")).first()
        if top:
            return f"sdtmct-{top['v']}"
    versions = [s.get("Version") or s.get("PublishingSet", "") for s in (study.define or {}).get("standards", []) if s.get("Type") == "CT"]
    return f"sdtmct-{max(versions)}" if versions else None
