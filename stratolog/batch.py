"""Analyse every log of a folder and write one page for each."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .framework import Discovery
from .sources.files import READERS, read_log


def analyse_folder(spark: SparkSession, input_dir: str | Path, output_dir: str | Path, recursive: bool = True) -> list[dict[str, str]]:
    """input_path, output_path, status and, after a failure, error of each log, in order of path; one bad log does not stop the others."""
    source, target = Path(input_dir), Path(output_dir)
    target.mkdir(parents=True, exist_ok=True)
    results = []
    for path in sorted(source.glob("**/*" if recursive else "*")):
        if not path.is_file() or path.suffix.lower() not in READERS:
            continue
        page = target / path.relative_to(source).with_suffix(".html")
        row = {"input_path": str(path), "output_path": str(page), "status": "ok"}
        log = None
        try:
            log = read_log(spark, str(path))
            analysis = Discovery(log)
            analysis.get_layers()
            analysis.discover_models()
            analysis.visualize(title=path.stem, output_path=page)
        except Exception as failure:  # a report line is the contract here
            row |= {"status": "error", "error": str(failure).split("\n")[0] or type(failure).__name__}
        finally:
            if log is not None:
                log.release()
        results.append(row)
    return results


def status_table(spark: SparkSession, results: list[dict[str, str]]) -> DataFrame:
    return spark.createDataFrame([(r["input_path"], r["output_path"], r["status"], r.get("error")) for r in results], "input_path string, output_path string, status string, error string")
