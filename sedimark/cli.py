"""``python -m sedimark.cli``: a thin layer over :class:`sedimark.runs.engine.Engine`."""

from __future__ import annotations

import argparse
import sys

from sedimark.runs import documents, policy
from sedimark.runs.contracts import validate
from sedimark.runs.outcome import CommandResult, Refused, blocking, human


class _Invalid(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise _Invalid(message)


def _pair(parser, name: str, yes: str, no: str) -> None:
    """Three states: yes, no, not given."""
    both = parser.add_mutually_exclusive_group()
    both.add_argument(yes, dest=name, action="store_true", default=None)
    both.add_argument(no, dest=name, action="store_false")


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="sedimark", description="Read-only evidence about file collections.")
    top.add_argument("--state-directory")
    top.add_argument("--config")
    top.add_argument("--no-config", action="store_true")
    top.add_argument("--json", action="store_const", const="json", dest="output_format")
    top.add_argument("--output-format", choices=("human", "json"), dest="output_format")
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    commands.add_parser("doctor")
    scan = commands.add_parser("scan")
    scan.add_argument("inputs", nargs="+")
    _pair(scan, "follow_symlinks", "--follow-symlinks", "--no-follow-symlinks")
    _pair(scan, "include_hidden", "--include-hidden", "--exclude-hidden")
    _pair(scan, "cross_filesystems", "--cross-filesystems", "--stay-on-filesystem")
    _pair(scan, "probe_media", "--probe", "--no-probe")
    commands.add_parser("report").add_argument("run")
    plan = commands.add_parser("plan").add_subparsers(dest="plan", required=True, parser_class=_Parser).add_parser("exact-duplicates")
    plan.add_argument("--run", required=True)
    plan.add_argument("--output")
    commands.add_parser("cache").add_subparsers(dest="cache", required=True, parser_class=_Parser).add_parser("status")
    config = commands.add_parser("config").add_subparsers(dest="config_command", required=True, parser_class=_Parser)
    config.add_parser("validate")
    config.add_parser("show")
    config.add_parser("explain").add_argument("setting")
    return top


def run(arguments: list[str], spark=None) -> tuple[CommandResult, str]:
    """(result, output format) of a command line; an unreadable one is a result too."""
    wants_json = "--json" in arguments or "--output-format=json" in arguments or ("--output-format" in arguments and "json" in arguments)
    try:
        told = parser().parse_args(arguments)
    except _Invalid as error:
        return CommandResult.resolve("unknown", diagnostics=[blocking("invalid_invocation", "input", str(error))]), "json" if wants_json else "human"
    line = {f"evidence_policy.{k}": getattr(told, k, None) for k in ("follow_symlinks", "include_hidden", "cross_filesystems", "probe_media")}
    line |= {"operational_policy.state_directory": told.state_directory, "presentation_policy.output_format": told.output_format}
    try:
        resolution = policy.resolve(line, told.config, told.no_config)
    except Refused as refused:
        return CommandResult.resolve(told.command, diagnostics=[refused.diagnostic]), told.output_format or "human"
    shape = resolution.values["presentation_policy.output_format"]
    from sedimark.runs.engine import Engine, Signals

    if told.command == "config":
        return Engine(None, resolution).config(told.config_command, getattr(told, "setting", None)), shape
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("sedimark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, resolution, Signals(spark).install())
    if told.command == "scan":
        return engine.scan(told.inputs), shape
    if told.command == "report":
        return engine.report(told.run), shape
    if told.command == "plan":
        return engine.plan(told.run, told.output), shape
    return (engine.cache_status() if told.command == "cache" else engine.doctor()), shape


def main(arguments: list[str] | None = None) -> int:
    result, shape = run(sys.argv[1:] if arguments is None else arguments)
    envelope = result.as_dict()
    validate("command_result", envelope)
    if shape == "json":
        sys.stdout.writelines(documents.pieces(envelope))
        sys.stdout.write("\n")
    else:
        out, err = human(result)
        sys.stdout.write(out)
        sys.stderr.write(err)
    return result.exit_code


if __name__ == "__main__":
    sys.exit(main())
