"""Versioned reports as JSON or text. Reports of results hold a page; a report of links is a head and rows that executors write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from .. import shared

VERSION = 1
#: Names that readers of reports rely on, here and in the keys below.
KINDS = ("search_report", "link_local_report", "download_report", "config_report", "config_path_report", "config_init_report", "error_report")
LINKED_BY = {"md5": "linked_by_md5", "isbn": "linked_by_isbn", "original_filename": "linked_by_original_filename", "title_author": "linked_by_title_author"}


def content(kind: str, **values) -> dict:
    if kind not in KINDS:
        raise ValueError(kind)
    return {"report_version": VERSION, "kind": kind, **values}


def report(kind: str, **values) -> str:
    return json.dumps(content(kind, **values), indent=2, ensure_ascii=False, default=str)


def error_report(error: Exception) -> str:
    return report("error_report", error=str(error))


def rows_of(df: DataFrame, columns) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.select(*columns).collect()]


def search_report(mode: str, value: str, filters, rows: list[dict], expand: bool = False, expansion: dict | None = None) -> str:
    asked = {"mode": mode, "value": value, "filters": {k: getattr(filters, k) for k in ("language", "extension", "year", "limit")}, "expand_requested": expand}
    return report("search_report", request=asked, result_count=len(rows), results=rows, **({"expansion": expansion} if expansion is not None else {}))


def link_statistics(stats: dict) -> dict:
    """Of linking.statistics; an unreadable file counts as unmatched."""
    return {"files_scanned": stats["files"], "files_hashed_md5": stats.get("hashed", 0), "linked_total": stats["matched"], **{name: stats[f"matched_{m}"] for m, name in LINKED_BY.items()}, "unmatched": stats["unmatched"] + stats.get("unreadable", 0), "ambiguous": stats["ambiguous"]}


def _without_nulls(value):
    if isinstance(value, dict):
        return {k: _without_nulls(v) for k, v in value.items() if v is not None}
    return [_without_nulls(v) for v in value] if isinstance(value, list) else value


def link_report(stats: dict, entries: DataFrame, dry_run: bool) -> str:
    """One text, for runs over few files."""
    rows = [_without_nulls(r.asDict(recursive=True)) for r in entries.orderBy("path").collect()]
    return report("link_local_report", dry_run=dry_run, stats=link_statistics(stats), entries=rows)


def write_link_report(stats: dict, entries: DataFrame, dry_run: bool, path: str) -> None:
    """The same for any number of files: ``report.json`` without entries, and these as JSON rows in ``entries``, absent fields left out."""
    entries.write.option("ignoreNullFields", "true").json(f"{path}/entries")
    shared.write_text(entries.sparkSession, f"{path}/report.json", content("link_local_report", dry_run=dry_run, stats=link_statistics(stats), entries="entries"))


def download_report(mode: str, value: str, record: dict, options: dict, destination: str, outcome: dict) -> str:
    """Of one file: what was asked for, the record, where it went, and what was done."""
    selector = {"selector": {"mode": mode, "value": value}}
    named = {"aa_id": record["aa_id"], "md5": record.get("md5") or "", **{k: record[k] for k in ("title", "author", "extension", "original_filename") if record.get(k) is not None}}
    asked = {k: options[k] for k in ("output_dir", "output_name", "filename_mode", "replace_existing", "verify_md5", "no_link", "path_index", "domain_index") if options.get(k) is not None}
    done = {k: outcome.get(k, False) for k in ("status", "network_used", "resumed_partial", "restarted_partial", "md5_checked")}
    return report("download_report", request=selector | asked, record=named, destination=destination, outcome=done | {"md5_ok": outcome.get("md5_ok"), "local_path_updated": outcome.get("local_path_updated", False)})


def config_report(file: str, exists: bool, settings: dict) -> str:
    """settings: config.Setting by key."""
    return report("config_report", config_file=file, config_exists=exists, values={k: {"value": s.value, "source": s.origin} for k, s in settings.items()})


def config_path_report(file: str, exists: bool) -> str:
    return report("config_path_report", path=file, exists=exists)


def config_init_report(file: str, overwritten: bool) -> str:
    return report("config_init_report", path=file, created=True, overwritten=overwritten)


def search_text(rows: list[dict]) -> str:
    lines = []
    for n, r in enumerate(rows, 1):
        score = "" if r.get("bm25_score") is None else f"  [{r['bm25_score']:.3f}]"
        lines += [f"{n}. {r.get('title') or 'no title'}{score}", f"   {' | '.join(str(r[k]) for k in ('author', 'year', 'language', 'extension') if r.get(k) is not None)}", f"   {r['aa_id']}"]
    return "\n".join(lines) or "nothing found"


def link_text(stats: dict) -> str:
    return "\n".join(f"{k.replace('_', ' ')}: {v}" for k, v in link_statistics(stats).items())


def expansion_text(told: dict) -> str:
    """An expansion's account, line by line."""
    head = [f"expansion of: {told['query_norm']}", f"attempted: {told['attempted']}", f"from the cache: {told['cache_hit']}"] + ([f"provider: {told['provider']}"] if told["provider"] else [])
    good = [f"taken: {a['text']} ({a['corpus_hits']} hits)" for a in told["accepted"]]
    return "\n".join(head + good + [f"refused: {r['text']} ({r['reason']})" for r in told["rejected"]] + ([f"skipped: {told['skipped']}"] if told["skipped"] else []))
