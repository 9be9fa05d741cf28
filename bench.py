"""Benchmark: median of three warm runs per query, one JSON line on stdout.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Messages are landed
once (by month: there are few a day), as an ingest would leave them; reading them is part of every
timing. ``growth`` gives the seconds of some queries on five times the rows over those on one.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from mailsieve.functions.redaction import redact, redaction_report
from mailsieve.functions.redaction_rules import ALL_CATEGORIES, DEFAULT_CATEGORIES
from mailsieve.functions.text import clean_text, html_to_text
from mailsieve.functions.redaction import redact_text
from mailsieve.operators import analyses
from mailsieve.operators.fields import FIELD_SETS
from mailsieve.operators.options import ExportOptions
from mailsieve.plans.export import export_rows, run_export
from mailsieve.plans.mailbox import dump
from mailsieve.sources.messages import land_messages, read_landed
from mailsieve.sources.session import local_session, work_path
from mailsieve.sources.tables import spread, table

RUNS = 3
GROWTH = 5


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), partitions=int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    arrived, landed = work_path(spark, "dump"), work_path(spark, "landed")
    dump(spark, folder).drop("headers").write.parquet(arrived)
    land_messages(spark.read.parquet(arrived), landed, period="month")
    larger = spark.read.parquet(arrived).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(GROWTH))))
    larger = larger.withColumn("id", F.concat("id", F.lit("-"), "copy")).drop("copy")
    land_messages(larger, f"{landed}-larger", period="month")

    def documents():
        return spread(table(spark, folder, "documents").select("doc_id", "text"))

    def pages():
        return spread(table(spark, folder, "pages").select("page_id", "html"))

    def messages(path=landed):
        return spread(read_landed(spark, path))

    def redacted(categories):
        return lambda: consume(documents().select("doc_id", redact(F.col("text"), categories).alias("r")))

    def page_text():
        text = redact_text(clean_text(html_to_text(F.col("html"))))
        consume(pages().select("page_id", text.alias("text")))

    def export(fields, **options):
        return lambda: consume(export_rows(messages(), ExportOptions(fields=FIELD_SETS[fields], **options)))

    def rolled():
        options = ExportOptions(
            fields=FIELD_SETS["all"],
            sanitize=True,
            max_bytes_per_file=1_000_000,
            output_dir=work_path(spark, "export"),
        )
        run_export(messages(), options).collect()

    queries = {
        "redact_default": redacted(DEFAULT_CATEGORIES),
        "redact_all": redacted(ALL_CATEGORIES),
        "redaction_report": lambda: redaction_report(documents(), "text").collect(),
        "clean_documents": lambda: consume(documents().select(clean_text(F.col("text")).alias("t"))),
        "html_clean_redact": page_text,
        "export_default": export("default"),
        "export_all_redacted": export("all", sanitize=True),
        "export_all_rolled": rolled,
        "contact_list": lambda: consume(analyses.contact_list(messages())),
        "thread_summary": lambda: consume(analyses.thread_summary(messages())),
        "reply_links": lambda: consume(analyses.reply_links(messages())),
        "mail_by_domain": lambda: consume(analyses.mail_by_domain(messages())),
    }
    sizes = {
        "documents": documents().agg(F.count("*"), F.sum(F.octet_length("text"))).first(),
        "pages": pages().agg(F.count("*"), F.sum(F.octet_length("html"))).first(),
        "messages": spark.read.parquet(arrived).agg(F.count("*"), F.sum(F.octet_length("payload"))).first(),
    }
    source = dict.fromkeys(queries, "messages") | {
        "redact_default": "documents",
        "redact_all": "documents",
        "redaction_report": "documents",
        "clean_documents": "documents",
        "html_clean_redact": "pages",
    }

    def measured(run):
        run()
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        return round(statistics.median(times), 3)

    growing = {
        "contact_list": lambda path: consume(analyses.contact_list(messages(path))),
        "thread_summary": lambda path: consume(analyses.thread_summary(messages(path))),
        "export_all_redacted": lambda path: consume(
            export_rows(messages(path), ExportOptions(fields=FIELD_SETS["all"], sanitize=True))
        ),
    }
    seconds, rates = {}, {}
    for name, run in queries.items():
        seconds[name] = measured(run)
        rows, size = sizes[source[name]]
        rates[name] = {
            "rows_per_s": round(rows / seconds[name]),
            "mb_per_s": round(size / seconds[name] / 1e6, 1),
        }
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "growth": {
                    name: round(measured(lambda run=run: run(f"{landed}-larger")) / seconds[name], 2)
                    for name, run in growing.items()
                },
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
