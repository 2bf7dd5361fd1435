"""JSON and JSONL sinks, transactional report files, create-only registries."""

from __future__ import annotations

import html
import json
import os
import tempfile
from collections.abc import Mapping
from hashlib import sha256
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .strict_json import canonical, load


def json_lines(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.json(path)


def nested_impressions(candidates: DataFrame) -> DataFrame:
    """A row for each impression with its candidates in source order."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "article_id", (F.col("clicked") == 1).alias("clicked"))))
    return candidates.groupBy("impression_id", "user_id", "occurred_us").agg(F.transform(listed, lambda c: F.struct(c["article_id"].alias("article_id"), c["clicked"].alias("clicked"))).alias("candidates"))


def write_all(files: Mapping[str, str]) -> None:
    """Replace several report files together: all are staged beside their targets first;
    if a later rename fails, earlier ones are put back."""
    staged: list[tuple[Path, Path]] = []
    backups: list[tuple[Path, Path | None]] = []
    try:
        for name, text in files.items():
            target = Path(name)
            handle, aside = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            staged.append((Path(aside), target))
        for aside, target in staged:
            old = None
            if target.exists():
                old = target.with_name(f".{target.name}.old")
                os.link(target, old)
            backups.append((target, old))
            os.replace(aside, target)
    except BaseException:
        for target, old in reversed(backups):
            if old is not None:
                os.replace(old, target)
            else:
                target.unlink(missing_ok=True)
        raise
    finally:
        for aside, _ in staged:
            aside.unlink(missing_ok=True)
        for _, old in backups:
            if old is not None:
                old.unlink(missing_ok=True)


def register(folder: str, record: Mapping[str, object]) -> str:
    """Write a record under its digest, once; the path.  The same record again is that file."""
    text = canonical(record)
    path = Path(folder) / f"{sha256(text.encode()).hexdigest()}.json"
    Path(folder).mkdir(parents=True, exist_ok=True)
    handle, aside = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(aside, path)
        except FileExistsError:
            if path.read_text(encoding="utf-8") != text:
                raise
    finally:
        os.unlink(aside)
    return str(path)


def verify(path: str, again: Mapping[str, object]) -> dict[str, object]:
    """A registered record, after a check of its name and of a replay, byte by byte."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).stem != sha256(text.encode()).hexdigest():
        raise ValueError("the record was changed")
    if canonical(again) != text:
        raise ValueError("a replay gives another record")
    return load(text)


def feed_report(title: str, rows: list[dict]) -> str:
    """A slate as a page."""
    lines = "".join(f"<tr><td>{r['rank']}</td><td>{html.escape(str(r['article_id']))}</td><td>{html.escape(str(r.get('source', '')))}</td><td>{r['score']:.4f}</td></tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr><th>rank<th>article<th>source<th>score</tr>{lines}</table>\n"


def benchmark_report(title: str, rows: list[dict]) -> str:
    """Policies and their means as a page."""
    names = list(rows[0]) if rows else []
    head = "".join(f"<th>{html.escape(n)}" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(f'{v:.6f}' if isinstance(v, float) else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>\n"


def dump(value: object) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"
