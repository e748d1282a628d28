"""Numbers, tables and pages from small collected results."""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame, SparkSession

MISSING = "–"


def known(x) -> bool:
    return x is not None and not (isinstance(x, float) and not math.isfinite(x))


def percent(x, digits: int = 1) -> str:
    return f"{100 * x:.{digits}f} %" if known(x) else MISSING


def signed_percent(x, digits: int = 1) -> str:
    return f"{100 * x:+.{digits}f} %" if known(x) else MISSING


def interval(low, high, digits: int = 1) -> str:
    return f"[{100 * low:.{digits}f}, {100 * high:.{digits}f}]" if known(low) and known(high) else MISSING


def usd(x, digits: int = 2) -> str:
    return f"${x:,.{digits}f}" if known(x) else MISSING


def usd_per_1k(x) -> str:
    """Per thousand tasks; small amounts with four places."""
    return usd(1000 * x, 4 if 1000 * x < 0.01 and x else 2) if known(x) else MISSING


def whole(x) -> str:
    return f"{round(x):,}" if known(x) else MISSING


def seconds(x) -> str:
    return f"{x:.2f}" if known(x) else MISSING


def share(x) -> str:
    """A share of escalated items; tiny ones aren't rounded away."""
    return MISSING if not known(x) else "<1 %" if 0 < x < 0.01 else f"{100 * x:.0f} %"


def cell(x) -> str:
    if isinstance(x, bool):
        return "yes" if x else "no"
    text = MISSING if not known(x) else f"{x:g}" if isinstance(x, float) else str(x)
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def markdown(df: DataFrame, limit: int = 500) -> str:
    """A table of a small result; what is beyond the limit is counted below it."""
    rows = df.limit(limit + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:limit]]
    return "\n".join(lines + ([f"\nMore than {limit} rows."] if len(rows) > limit else [])) + "\n"


def page(title: str, blocks: dict[str, DataFrame]) -> str:
    parts = [f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in blocks.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        rows = df.limit(501).collect()
        body = "".join("<tr>" + "".join(f"<td>{html.escape(cell(x))}</td>" for x in r) + "</tr>" for r in rows[:500])
        more = "<p>More than 500 rows.</p>" if len(rows) > 500 else ""
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>{more}")
    return "\n".join(parts) + "\n"


#: Blocks of the report and the queries that give them.
BLOCKS = {
    "Results": ("results_table", ["task", "kind_order", "model_id"]),
    "Local performance": ("local_perf", ["model_id", "task"]),
    "Break-even": ("break_even_table", ["task"]),
    "Candidates": ("candidate_table", ["task", "split", "model_id"]),
    "Tasks that meet the bar": ("router_matrix", ["row_name"]),
    "Data": ("data_cards", ["lang", "source"]),
    "Calls": ("call_stats", ["model_id"]),
    "Sensitivity": ("sensitivity_grid", ["years", "mult"]),
    "Plan": ("plan_table", ["task"]),
    "Replay": ("replay_tasks", ["row_name", "split", "task"]),
    "Mixed workload": ("mixed_table", ["row_name"]),
    "Verdicts": ("task_verdict", ["task"]),
    "Judge": ("judge_table", ["model_id"]),
    "Spend": ("ledger_by_command", ["pipeline_order", "command"]),
}


def report(spark: SparkSession, sf_dir: str) -> str:
    """The whole report as Markdown."""
    from .. import catalog

    queries = catalog.queries()
    return "\n".join(f"## {title}\n\n{markdown(queries[name](spark, sf_dir).orderBy(*order))}" for title, (name, order) in BLOCKS.items())


def number(x, digits: int = 0) -> str:
    return f"{x:,.{digits}f}" if known(x) else MISSING


def gigabytes(x, digits: int = 1) -> str:
    return f"{x / 1e9:.{digits}f} GB" if known(x) else MISSING


def gibibytes(x, digits: int = 2) -> str:
    return f"{x / 2**30:.{digits}f} GiB" if known(x) else MISSING


def milliseconds(x) -> str:
    return f"{1000 * x:,.1f} ms" if known(x) else MISSING


def watts(x) -> str:
    return f"{x:.0f} W" if known(x) else MISSING


def yes(x) -> str:
    return MISSING if x is None else "yes" if x else "no"


_INLINE = [(re.compile(r"`([^`]+)`"), r"<code>\1</code>"), (re.compile(r"\*\*([^*]+)\*\*"), r"<strong>\1</strong>"), (re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)"), r'<a href="\2">\1</a>')]


def _inline(text: str) -> str:
    out = html.escape(text, quote=False)
    for pattern, made in _INLINE:
        out = pattern.sub(made, out)
    return out


def to_html(markdown_text: str) -> str:
    """Headings, paragraphs, lists, tables and inline marks of Markdown as HTML; anything else is a paragraph."""
    out, rows, items, words = [], [], [], []

    def flush() -> None:
        if words:
            out.append(f"<p>{_inline(' '.join(words))}</p>")
        if items:
            out.append("<ul>" + "".join(f"<li>{_inline(x)}</li>" for x in items) + "</ul>")
        if rows:
            cells = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", r.strip().strip("|"))] for r in rows]
            body = [r for r in cells[1:] if not all(re.fullmatch(r":?-+:?", c) for c in r)]
            out.append("<table><tr>" + "".join(f"<th>{_inline(c)}</th>" for c in cells[0]) + "</tr>" + "".join("<tr>" + "".join(f"<td>{_inline(c)}</td>" for c in r) + "</tr>" for r in body) + "</table>")
        rows.clear(), items.clear(), words.clear()

    for line in markdown_text.splitlines():
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            flush()
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
        elif line.startswith("|"):
            if words or items:
                flush()
            rows.append(line)
        elif m := re.match(r"[-*]\s+(.*)", line):
            if words or rows:
                flush()
            items.append(m[1])
        elif line.strip():
            if items or rows:
                flush()
            words.append(line.strip())
        else:
            flush()
    flush()
    return "\n".join(out) + "\n"


def headline_text(met: dict[str, str], tasks: int, headline: dict, saving: dict, refused: list[str] = ()) -> str:
    """The report's sentences: where local models met the bar, the headline task's break-even, the router's saving.

    met: best local model by task that meets its bar; headline: task, any_met, verdict, volume, monthly; saving: pct, versus, scope.
    """
    if met:
        named = [f"{t} ({m})" for t, m in sorted(met.items())]
        joined = named[0] if len(named) == 1 else ", ".join(named[:-1]) + " and " + named[-1]
        first = f"A local model met the quality bar on {'only ' if 2 * len(met) < tasks else ''}{len(met)} of {tasks} tasks: {joined}"
    else:
        first = f"No local model met the quality bar on any of the {tasks} tasks"
    first += "".join(f"; {t}, which must stay local, is refused" for t in sorted(refused)) + "."
    task = f"The {'' if headline.get('any_met') else 'fallback '}headline task, {headline['task']},"
    if headline.get("verdict") == "break-even" and known(headline.get("volume")):
        second = f"{task} breaks even at {number(headline['volume'])} tasks a month (its volume: {number(headline.get('monthly'))})."
    elif headline.get("verdict") == "no-cloud":
        second = f"{task} has no break-even volume: no cloud model met its bar."
    else:
        second = f"{task} gets the verdict {headline.get('verdict') or MISSING} at {number(headline.get('monthly'))} tasks a month."
    if not known(saving.get("pct")):
        third = "The router's saving could not be computed."
    else:
        who = f"The router ({saving['scope']})" if saving.get("scope") else "The router"
        third = f"{who} costs {abs(saving['pct']):.1f}% {'less' if saving['pct'] >= 0 else 'more'} on the mixed workload than {saving.get('versus')}."
    return " ".join([first, second, third])


def decision_record(number_: int, title: str, verdicts: list[dict], headline: str, date_: str) -> str:
    """A decision record in Markdown: context, decision by task, consequences."""
    rows = "\n".join(f"| {cell(v['task'])} | {cell(v['verdict'])} | {cell(v['detail'])} |" for v in verdicts)
    local = sorted(v["task"] for v in verdicts if v["verdict"].startswith("local"))
    return f"# {number_:04d}. {title}\n\nDate: {date_}\n\n## Context\n\n{headline}\n\n## Decision\n\n| task | verdict | why |\n|---|---|---|\n{rows}\n\n## Consequences\n\n- Served locally: {', '.join(local) or 'no task'}.\n- Measured again when models, prices or volumes change.\n"


def record(spark: SparkSession, sf_dir: str, date_: str) -> str:
    """The decision record of a folder's run."""
    from .. import catalog, sql

    q = catalog.queries()
    one = lambda df: df.first().asDict() if df.head(1) else {}
    head = one(q["headline_task"](spark, sf_dir))
    even = {r["task"]: r.asDict() for r in sql.run(spark, sf_dir, "SELECT task, verdict, volume, monthly FROM break_even").collect()}
    met = {r["task"]: r["best_local"] for r in sql.run(spark, sf_dir, "SELECT task, best_local FROM task_facts WHERE local_meets").collect()}
    saving = one(q["headline_saving"](spark, sf_dir))
    refused = [r["task"] for r in q["refused_tasks"](spark, sf_dir).collect() if "no constraints" not in r["row_name"]]
    verdicts = [r.asDict() for r in q["task_verdict"](spark, sf_dir).orderBy("task").collect()]
    text = headline_text(met, len(verdicts), head | even.get(head["task"], {}), {"pct": saving.get("saving_pct"), "versus": saving.get("versus"), "scope": saving.get("scope")}, refused)
    return decision_record(1, "Where tasks are served", verdicts, text, date_)
