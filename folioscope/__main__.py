"""python -m folioscope COMMAND: the commands over a folder of Parquet tables."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone
from pathlib import Path

HERE = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH", "")) if x)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from folioscope.config import ModelConfig  # noqa: E402
from folioscope.operators import canonical, model, resolve, search  # noqa: E402
from folioscope.plans import api, commands  # noqa: E402
from folioscope.session import cut, get_session  # noqa: E402
from folioscope.sources import corpus, sinks  # noqa: E402
from folioscope.streaming import manifest, steps  # noqa: E402


class Store:
    """Tables below one folder, each replaced at once (``sinks.swap_table``)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return sinks.read_table(self.spark, f"{self.folder}/{name}")

    def has(self, name: str) -> bool:
        return sinks.current_version(self.spark, f"{self.folder}/{name}") is not None

    def write(self, name: str, df: DataFrame) -> None:
        sinks.swap_table(df, f"{self.folder}/{name}")

    def pairs(self, args: argparse.Namespace) -> DataFrame:
        return commands.find_duplicates(self.read("entities"), self.read("entity_aliases"), args.target or "person", args.min_occurrences, args.pairs)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    s = Store(spark, args.tables)
    seeds = dict(x.split("=", 1) for x in args.seed)
    ask = model.caller(ModelConfig.from_env()) if args.model else None
    match args.command:
        case "survey":
            classified, report = commands.run_survey(spark, args.target, seeds)
            s.write("classifications", classified)
            if args.output:
                sinks.write_json(report, args.output)
            return report
        case "report":
            return corpus.read_report(spark, args.target)
        case "list-emails":
            return api.list_emails(s.read("classifications"), args.least if args.least is not None else 0.7, args.target)
        case "load":
            docs, named, counts = commands.load(s.read("classifications"), corpus.read_corpus(spark, args.target))
            s.write("documents", docs)
            s.write("entity_mentions", named)
            search.write_index(s.read("documents"), "doc_id", "full_text", f"{args.tables}/index")
            return counts
        case "extract-entities":
            tables = commands.extract(s.read("documents"), doc_ids=args.doc_id or None, extractor=model.extractor(ask) if ask else None)
            for name, df in tables.items():
                s.write(name, df)
            return commands.extraction_counters({n: s.read(n) for n in tables}, s.read("documents"))
        case "init-canonical":
            there = (s.read("canonical_entities"), s.read("entity_aliases")) if s.has("canonical_entities") and not args.force else None
            c, a = canonical.initialise(s.read("entities"), existing=there)
            if there is None or c is not there[0]:
                s.write("canonical_entities", c)
                s.write("entity_aliases", a)
            return canonical.stats(s.read("canonical_entities"), s.read("entity_aliases"))
        case "find-duplicates":
            if args.output:
                sinks.write_json(resolve.report(s.pairs(args).drop("ord")), args.output)
            return s.pairs(args)
        case "auto-merge":
            # All three are made before the tables that they come from are replaced.
            aliases, left, log = map(cut, commands.auto_merge(s.pairs(args), s.read("entity_aliases"), s.read("canonical_entities"), s.read("entities"), args.least if args.least is not None else 0.95, args.dry_run))
            if not args.dry_run:
                s.write("entity_aliases", aliases)
                s.write("canonical_entities", left)
            if args.output:
                sinks.write_json(log, args.output)
            return log
        case "llm-review":
            if ask is None and not args.dry_run:
                raise SystemExit("llm-review needs --model and a model that is enabled in the environment")
            decide = model.reviewer(ask) if ask else (lambda *names: (False, "dry run"))
            aliases, verdicts = map(cut, commands.review(s.pairs(args), s.read("document_entities").withColumnRenamed("ordinal", "mention_id"), s.read("entity_aliases"), decide, dry_run=args.dry_run))
            if not args.dry_run:
                left = cut(canonical.totals(s.read("canonical_entities"), aliases, s.read("entities")))
                s.write("entity_aliases", aliases)
                s.write("canonical_entities", left)
            if args.output:
                sinks.write_json(verdicts, args.output)
            return verdicts
        case "merge-report":
            return resolve.report(s.pairs(args).drop("ord"))
        case "run-steps":
            docs = s.read("documents").select("doc_id", "filepath", "full_text")
            wanted = steps.all_steps(model.extractor(ask) if ask else None)
            wanted = tuple(x for x in wanted if x.name == args.target) if args.target else wanted
            if not wanted:
                raise SystemExit(f"no step is named {args.target}")
            path, now = f"{args.tables}/manifests", datetime.now(timezone.utc).isoformat()
            known = manifest.load_manifests(spark, path)
            fresh = manifest.create(docs, "doc_id", "filepath", now).join(known.select("doc_id"), "doc_id", "left_anti")
            done = known.unionByName(fresh)
            done = manifest.run_all(done, docs, wanted, now) if not args.target else cut(manifest.run_step(cut(done), docs, wanted[0], now))
            manifest.write_manifests(done, path)
            return manifest.summary(manifest.load_manifests(spark, path))
        case "search":
            postings, lengths = search.read_index(spark, f"{args.tables}/index")
            return search.search(s.read("documents"), postings, lengths, args.target, args.limit).select("doc_id", "filepath", "rank", "snippet")
        case "query-entity":
            d = s.read("document_entities").withColumnRenamed("ordinal", "mention_id")
            return api.entity_mentions(s.read("entities"), d.drop("text", "type"), s.read("documents"), args.target, None, args.limit)
        case "find-threads":
            return api.email_threads(s.read("thread_messages"), s.read("documents"), s.read("email_metadata"), args.target, args.limit)
        case "show-dlq":
            return api.dead_letters(s.read("email_metadata"), s.read("documents"), args.limit)
        case "document":
            return api.get_document(s.read("documents"), s.read("entity_mentions"), args.target)
        case "stats":
            return api.document_stats(s.read("documents"), s.read("entity_mentions"))
    return None


COMMANDS = "survey report list-emails load extract-entities init-canonical find-duplicates auto-merge llm-review merge-report run-steps search query-entity find-threads show-dlq document stats".split()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("target", nargs="?", help="folder of texts, report, query, name, type, step or id")
    p.add_argument("--tables", default="tables", help="folder of the tables")
    p.add_argument("--seed", action="append", default=[], help="NAME=PATTERN of a seed entity")
    p.add_argument("--limit", type=int, default=20, help="rows of a list")
    p.add_argument("--pairs", type=int, default=200, help="pairs of a duplicate report")
    p.add_argument("--min-occurrences", type=int, default=5, help="least occurrences of an entity in a duplicate report")
    p.add_argument("--least", type=float, help="least confidence")
    p.add_argument("--doc-id", action="append", default=[], help="only this document; may be repeated")
    p.add_argument("--output", help="folder for the report, log or verdicts as JSON")
    p.add_argument("--model", action="store_true", help="ask the model that the environment names")
    p.add_argument("--force", action="store_true", help="make canonical records anew")
    p.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or get_session()
    out = run(spark, args)
    if out is not None:
        for line in out.toJSON().take(max(args.limit, 100)):
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
