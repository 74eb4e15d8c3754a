"""Small inputs that the driver reads: strict settings, run manifests, HTML tables; and stores of embedding arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _no_repeats(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"key given twice: {k}")
        out[k] = v
    return out


def strict_settings(path: str, required: list[str]) -> dict[str, Any]:
    """Settings from JSON, or from YAML where its library is installed; a repeated or missing key is an error."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        class Strict(yaml.SafeLoader):
            pass

        def mapping(loader: Any, node: Any) -> dict[str, Any]:
            return _no_repeats([(loader.construct_object(k, True), loader.construct_object(v, True)) for k, v in node.value])

        Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
        found = yaml.load(text, Strict)  # noqa: S506
    else:
        found = json.loads(text, object_pairs_hook=_no_repeats)
    missing = [k for k in required if k not in (found or {})]
    if missing:
        raise ValueError(f"settings lack {', '.join(missing)}")
    return found


def same_run(path: str, wanted: dict[str, Any]) -> None:
    """Writes the manifest of a run, or refuses to resume one whose fields differ."""
    file = Path(path)
    if file.exists():
        held = json.loads(file.read_text(encoding="utf-8"))
        differs = sorted(k for k in wanted if held.get(k) != wanted[k])
        if differs:
            raise ValueError(f"the run in {path} differs in {', '.join(differs)}")
        return
    part = file.with_suffix(file.suffix + ".part")
    part.write_text(json.dumps(wanted, indent=1, sort_keys=True), encoding="utf-8")
    part.replace(file)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def read_html_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The first table of a page as strings, headed by its first row; a missing required column is an error."""
    parser = _Tables()
    parser.feed(Path(path).read_text(encoding="utf-8"))
    rows = [r for r in (parser.tables[0] if parser.tables else []) if r]
    head = rows[0] if rows else []
    missing = [c for c in required if c not in head]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    body = [tuple((r + [""] * len(head))[: len(head)]) for r in rows[1:]]
    return spark.createDataFrame(body, ", ".join(f"`{c}` string" for c in head))


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    """folder, key, token, layer, vec of a store: folders with keys.txt, done.json and ``token@layer.npy``.

    A folder without done.json was not finished: an error.  Each array file is
    one task's input; rows follow keys.txt.
    """
    from pyarrow import fs

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root).select("path")

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                system, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                folder, name = place.rsplit("/", 1)
                if system.get_file_info(f"{folder}/done.json").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{folder} was not finished")
                with system.open_input_file(f"{folder}/keys.txt") as f:
                    keys = f.read().decode().split()
                token, layer = name[: -len(".npy")].rsplit("@", 1)
                with system.open_input_file(place) as f:
                    array = np.load(f).astype(np.float32)
                if len(array) != len(keys):
                    raise ValueError(f"{place} has {len(array)} rows for {len(keys)} keys")
                for start in range(0, len(keys), 8192):
                    part = slice(start, start + 8192)
                    yield pd.DataFrame({"folder": folder, "key": keys[part], "token": token, "layer": layer, "vec": list(array[part])})

    return files.mapInPandas(load, "folder string, key string, token string, layer string, vec array<float>")
