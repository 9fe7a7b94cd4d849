"""Queries of the operators that prepare training text."""

from __future__ import annotations

from kestrel.llm import batches, docs, handwritten, leaks, mixing, near_dups, secrets, truncation, validity
from kestrel.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _files(spark, d):
    return table(spark, d, "source_files")


def _chunks(spark, d):
    return table(spark, d, "chunks")


@query("p1_found")
def p1_found(spark, d):
    return validity.invalid_files(_files(spark, d))


@query("p1_errors")
def p1_errors(spark, d):
    return validity.file_errors(_files(spark, d), _chunks(spark, d))


@query("p1_all_errors")
def p1_all_errors(spark, d):
    return validity.all_errors(_files(spark, d))


@query("p1_acceptance")
def p1_acceptance(spark, d):
    return validity.acceptance(_files(spark, d))


@query("p1_rates")
def p1_rates(spark, d):
    return validity.error_rates(_files(spark, d))


@query("p4_found", near_dups.FOUND_SQL)
def p4_found(spark, d):
    return near_dups.near_pairs(_chunks(spark, d))


@query("p4_links", near_dups.LINKS_SQL)
def p4_links(spark, d):
    return near_dups.near_links(_chunks(spark, d))


@query("p4_class_pairs", near_dups.PAIRS_SQL)
def p4_class_pairs(spark, d):
    return near_dups.class_pairs(_chunks(spark, d))


@query("p4_class_members", near_dups.MEMBERS_SQL)
def p4_class_members(spark, d):
    return near_dups.class_members(_chunks(spark, d))


@query("p6_found")
def p6_found(spark, d):
    return docs.documented_lines(_files(spark, d))


@query("p6_pairs")
def p6_pairs(spark, d):
    return docs.function_pairs(_files(spark, d))


@query("p6_statistics")
def p6_statistics(spark, d):
    return docs.pair_statistics(_files(spark, d), _chunks(spark, d))


def _documents(spark, d):
    return table(spark, d, "documents")


@query("p8_found", leaks.FOUND_SQL)
def p8_found(spark, d):
    return leaks.leaked(_documents(spark, d), table(spark, d, "eval_cases"))


@query("p8_report")
def p8_report(spark, d):
    return leaks.leak_report(_documents(spark, d), table(spark, d, "eval_cases"))


@query("p5_found")
def p5_found(spark, d):
    return secrets.credentials(_files(spark, d))


@query("p5_redacted")
def p5_redacted(spark, d):
    return secrets.redacted(_files(spark, d))


@query("p5_statistics")
def p5_statistics(spark, d):
    return secrets.statistics(_files(spark, d))


@query("p10_found")
def p10_found(spark, d):
    return truncation.cut_documents(_documents(spark, d))


@query("p10_rates")
def p10_rates(spark, d):
    return truncation.cut_rates(_documents(spark, d))


@query("p2_found")
def p2_found(spark, d):
    return handwritten.not_by_hand(_files(spark, d))


@query("p2_rates")
def p2_rates(spark, d):
    return handwritten.rates(_files(spark, d))


@query("p7_batches")
def p7_batches(spark, d):
    return batches.packed(_chunks(spark, d), table(spark, d, "embed_models"))


@query("p7_report")
def p7_report(spark, d):
    return batches.report(_chunks(spark, d), table(spark, d, "embed_models"))


@query("p7_totals", batches.TOTALS_SQL)
def p7_totals(spark, d):
    return batches.totals(_chunks(spark, d), table(spark, d, "embed_models"))


@query("p7_buckets_alone")
def p7_buckets_alone(spark, d):
    return batches.report(_chunks(spark, d), table(spark, d, "embed_models"), top_up=False)


@query("p9_draw")
def p9_draw(spark, d):
    return mixing.draw(_documents(spark, d), table(spark, d, "mix_targets"))


@query("p9_shares")
def p9_shares(spark, d):
    return mixing.shares(_documents(spark, d), table(spark, d, "mix_targets"))
