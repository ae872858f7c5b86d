"""The command line: profile, compare, diff, doctor, init, notebook, render, demo."""

from __future__ import annotations

import argparse
import difflib
import json
import sys
import tomllib
import webbrowser
from pathlib import Path
from typing import Any

from .sources.remote import MissingConnector, MissingCredential, parse_uri

# The keys of a configuration file.
KEYS = (
    "target time time_col exclude exclude_file ignore_missing_exclude filter where sample target_sample shortlist cluster_cutoff html save plotly_cdn fast deep all_columns approximate_quartiles bins max_cols".split()
)
PROFILE_KEYS = frozenset({"source_name", "columns", "findings", "n_rows", "n_cols"})
USER_ERRORS = (ValueError, FileNotFoundError, TypeError, MissingConnector, MissingCredential)


class UsageError(ValueError):
    """What the user can mend."""


def read_config(path: str | None, name: str | None) -> dict[str, Any]:
    """Settings of a TOML file, those of [profiles.NAME] over the others."""
    if path is None:
        if name:
            raise UsageError("--profile-name needs --config")
        return {}
    try:
        data = tomllib.loads(Path(path).expanduser().read_text())
    except OSError as e:
        raise UsageError(f"can't read {path}: {e.strerror}") from e
    except tomllib.TOMLDecodeError as e:
        raise UsageError(f"{path} isn't valid TOML: {e}") from e
    profiles = data.pop("profiles", {})
    _check_keys(data, path)
    if name:
        if name not in profiles:
            raise UsageError(f"{path} has no [profiles.{name}]; there are {', '.join(profiles) or 'none'}")
        _check_keys(profiles[name], f"{path} [profiles.{name}]")
        data |= profiles[name]
    return data


def _check_keys(data: dict[str, Any], where: str) -> None:
    for k in data:
        if k not in KEYS:
            near = difflib.get_close_matches(k, KEYS, 1)
            raise UsageError(f"{where}: unknown key {k!r}" + (f"; did you mean {near[0]!r}?" if near else ""))


def _list(x: Any, name: str) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    if not isinstance(x, list) or not all(isinstance(v, str) for v in x):
        raise UsageError(f"{name} must be a text or a list of texts")
    return x


def _number(x: Any, name: str, kind: type, low: float, high: float = float("inf")) -> Any:
    if x is None:
        return None
    if isinstance(x, bool) or not isinstance(x, (int, kind)) or not low <= x <= high:
        raise UsageError(f"{name} must be a number from {low:g}" + (f" to {high:g}" if high < float("inf") else " on"))
    return kind(x)


def _flag(c: dict[str, Any], name: str) -> bool | None:
    if name in c and not isinstance(c[name], bool):
        raise UsageError(f"{name} must be true or false")
    return c.get(name)


def _deep(args: argparse.Namespace, c: dict[str, Any]) -> bool:
    """Whether the slow analyses run: the command line's word, else the file's, which may say it by either key but not both ways."""
    fast, deep = _flag(c, "fast"), _flag(c, "deep")
    if args.fast and args.deep or (fast is not None and fast == deep):
        raise UsageError("fast and deep exclude each other" if args.fast or fast else "fast and deep are both off")
    if args.fast or args.deep:
        return args.deep
    return deep if deep is not None else fast is False


def options(args: argparse.Namespace) -> dict[str, Any]:
    """Keyword arguments of profile(): the command line over the file, lists one after the other."""
    c = read_config(args.config, args.profile_name)
    deep = _deep(args, c)
    pick = lambda a, *k: a if a is not None else next((c[x] for x in k if x in c), None)
    exclude = _list(c.get("exclude"), "exclude") + args.exclude
    if file := pick(args.exclude_file, "exclude_file"):
        lines = (x.split("#")[0].strip() for x in Path(file).expanduser().read_text().splitlines())
        exclude += [x for x in lines if x]
    size = {"sample": (pick(args.sample, "sample"), 1), "target_sample_size": (pick(args.target_sample, "target_sample") or 30_000, 100), "shortlist_size": (pick(args.shortlist, "shortlist"), 1), "hist_bins": (pick(args.bins, "bins") or 24, 1), "max_cols": (pick(args.max_cols, "max_cols"), 2)}
    return {
        "target": pick(args.target, "target"),
        "time_col": pick(args.time, "time", "time_col"),
        "exclude": exclude or None,
        "where": (_list(c.get("filter"), "filter") + _list(c.get("where"), "where") + args.filter) or None,
        "ignore_missing_exclude": bool(args.ignore_missing_exclude or _flag(c, "ignore_missing_exclude")),
        "exact_quantiles": not (args.approximate_quartiles or _flag(c, "approximate_quartiles")),
        "cluster_cutoff": _number(pick(args.cluster_cutoff, "cluster_cutoff"), "cluster_cutoff", float, 0, 1) if pick(args.cluster_cutoff, "cluster_cutoff") is not None else 0.30,
        "deep_correlations": deep,
        "target_permutation": deep,
        "credentials_env": args.credentials_env,
        **{k: _number(v, k, int, low) for k, (v, low) in size.items()},
    }


def _say(what: str, path: Path) -> None:
    print(f"{what}: {path}")


def _profile(args: argparse.Namespace) -> None:
    from .plans.profile import profile
    from .render.html import write_html
    from .render.text import render_text

    c = read_config(args.config, args.profile_name)
    p = profile(args.data, progress=(lambda m: print(f"... {m}", file=sys.stderr)) if args.progress else None, **options(args))
    print(render_text(p, bool(args.all_columns or _flag(c, "all_columns"))))
    if save := args.save or c.get("save"):
        _say("saved", p.save(save))
    if args.pipeline:
        Path(args.pipeline).write_text(p.to_sklearn_pipeline_code() if args.sklearn else p.to_spark_pipeline_code())
        _say("pipeline", Path(args.pipeline))
    if (html := args.html or c.get("html")) or args.open:
        out = write_html(p, html or f"{Path(p.source_name).stem}.html")
        _say("report", out)
        if args.open:
            webbrowser.open(out.resolve().as_uri())


def side(data: str, args: argparse.Namespace):
    """A saved profile where a JSON file has its keys, else a table to profile."""
    from .plans.profile import load_profile, profile

    if data.endswith(".json") and parse_uri(data) is None and Path(data).exists():
        try:
            seen = json.loads(Path(data).read_text())
        except ValueError:
            seen = None
        if isinstance(seen, dict) and seen.keys() >= PROFILE_KEYS:
            return load_profile(data)
    return profile(data, target=args.target, time_col=args.time, sample=args.sample, deep_correlations=False, target_permutation=False)


def _compare(args: argparse.Namespace) -> None:
    from .operators.drift import compare_profiles
    from .render.html import write_compare_html
    from .render.text import render_compare

    report = compare_profiles(side(args.a, args), side(args.b, args))
    print(render_compare(report))
    if args.save:
        _say("saved", report.save(args.save))
    if args.html:
        _say("report", write_compare_html(report, args.html))


def _diff(args: argparse.Namespace) -> None:
    from .plans.profile import load_profile
    from .render.text import render_diff

    print(render_diff(load_profile(args.a).diff(load_profile(args.b))))


def _doctor(args: argparse.Namespace) -> None:
    from .operators.columns import column_stats
    from .operators.roles import hints, infer_excludes, infer_target, infer_time
    from .render.text import _table
    from .sources.load import discover_schema, load

    if parse_uri(args.data) is not None:
        seen = discover_schema(args.data, args.credentials_env)
        print(f"{seen.name}: {seen.n_rows if seen.n_rows is not None else 'unknown number of'} rows")
        print("\n".join(_table(["column", "type", "kind"], [list(c) for c in seen.columns])))
        return
    stats = column_stats(load(args.data, sample=args.sample or 5000).frame)
    rows = [[s.name, s.kind, f"{s.null_rate:.1%}", str(s.n_unique), ", ".join(hints(s))] for s in stats.values()]
    print("\n".join(_table(["column", "kind", "missing", "unique", "looks like"], rows)))
    t, w = infer_target(stats), infer_time(stats)
    print(f"target: {t or '-'}  time: {w or '-'}  exclude: {', '.join(infer_excludes(stats, t, w)) or '-'}")


def _init(args: argparse.Namespace) -> None:
    from .operators.columns import column_stats
    from .operators.roles import infer_excludes, infer_target, infer_time
    from .plans.codegen import starter_config
    from .sources.load import load

    out = Path(args.output)
    if out.exists() and not args.force:
        raise UsageError(f"{out} is there already; --force writes over it")
    stats = column_stats(load(args.data, sample=10_000).frame)
    t, w = infer_target(stats), infer_time(stats)
    out.write_text(starter_config(t, w, infer_excludes(stats, t, w)))
    _say("config", out)


def _notebook(args: argparse.Namespace) -> None:
    from .plans.codegen import notebook

    out = Path(args.output)
    if out.exists() and not args.force:
        raise UsageError(f"{out} is there already; --force writes over it")
    out.write_text(notebook(args.data, args.target, args.time))
    _say("notebook", out)


def _render(args: argparse.Namespace) -> None:
    from .plans.profile import load_profile
    from .render.html import write_html

    _say("report", write_html(load_profile(args.profile), args.html))


def _demo(args: argparse.Namespace) -> None:
    from .plans.profile import profile
    from .render.html import write_html
    from .render.text import render_text
    from .session import session
    from .sources.demo import demo_frame

    df = demo_frame(session(), args.rows)
    if args.output:
        df.toPandas().to_csv(args.output, index=False)
        _say("data", Path(args.output))
    p = profile(df, target="churned", time_col="signup_date", source_name="demo", deep_correlations=False, target_permutation=False)
    print(render_text(p))
    if args.html:
        _say("report", write_html(p, args.html))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="riskloom", description="Find what in a table will hurt a model.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, help_: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help_)
        p.set_defaults(run=run)
        return p

    p = command("profile", _profile, "profile a file, folder or URI")
    p.add_argument("data")
    for flag in ("--target", "--time", "--config", "--profile-name", "--exclude-file", "--credentials-env", "--html", "--save", "--pipeline"):
        p.add_argument(flag)
    for flag in ("--sample", "--target-sample", "--shortlist", "--bins", "--max-cols"):
        p.add_argument(flag, type=int)
    p.add_argument("--cluster-cutoff", type=float)
    for flag in ("--exclude", "--filter"):
        p.add_argument(flag, action="append", default=[])
    for flag in ("--fast", "--deep", "--all-columns", "--approximate-quartiles", "--ignore-missing-exclude", "--open", "--sklearn", "--progress"):
        p.add_argument(flag, action="store_true")
    p = command("compare", _compare, "compare two tables or saved profiles")
    p.add_argument("a")
    p.add_argument("b")
    for flag in ("--target", "--time", "--html", "--save"):
        p.add_argument(flag)
    p.add_argument("--sample", type=int)
    p = command("diff", _diff, "what changed between two saved profiles")
    p.add_argument("a")
    p.add_argument("b")
    p = command("doctor", _doctor, "a quick look at the columns")
    p.add_argument("data")
    p.add_argument("--sample", type=int)
    p.add_argument("--credentials-env")
    p = command("init", _init, "write a starter configuration")
    p.add_argument("data")
    p.add_argument("--output", default="riskloom.toml")
    p.add_argument("--force", action="store_true")
    p = command("notebook", _notebook, "write a starter notebook")
    p.add_argument("data")
    p.add_argument("--output", default="profile.ipynb")
    p.add_argument("--target")
    p.add_argument("--time")
    p.add_argument("--force", action="store_true")
    p = command("render", _render, "HTML of a saved profile")
    p.add_argument("profile")
    p.add_argument("--html", default="profile.html")
    p = command("demo", _demo, "profile a made table")
    p.add_argument("--rows", type=int, default=5000)
    p.add_argument("--html")
    p.add_argument("--output")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args)
    except USER_ERRORS as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
