"""The five steps as functions from documents and what is known of them to outcomes, as JSON text.

A step sees the documents that are due for it (doc_id, full_text, ``steps``). Outcomes are read back from the steps' results, so that a run that
goes on tomorrow finds what was made today.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.operators import classify, emails, entities
from folioscope.streaming.manifest import STEPS, Step, get_step

# How many names of each kind the metadata keeps.
MOST = {"persons": 20, "organizations": 10, "locations": 10}
KINDS = {"persons": "person", "organizations": "organization", "locations": "location"}
_PLACED = "array<struct<name:string,confidence:double,method:string,start:int,end:int>>"


def outcome(name: str) -> Column:
    """The outcome of a step that succeeded, or null."""
    step = get_step(F.col("steps"), name)
    return F.when(step["status"] == "success", step["outcome"])


def run_classify(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.to_json(classify.document_type(F.col("full_text"))).alias("outcome"))


def run_email(docs: DataFrame) -> DataFrame:
    """Header fields of documents that were classified as mails; others are skipped, with the reason."""
    kind = F.get_json_object(outcome("classify"), "$.doc_type")
    typed = docs.withColumn("_kind", kind)
    parsed = emails.parse(typed.filter("_kind = 'email'"), "doc_id", "full_text").filter("mail is not null")
    m = F.col("mail")
    people = F.concat(F.array_compact(F.array(m["from_addr"])), m["to_addrs"], m["cc_addrs"], m["bcc_addrs"])
    done = F.struct(
        F.lit(False).alias("skipped"), m["from_addr"].alias("from"), m["to_addrs"].alias("to"), m["cc_addrs"].alias("cc"), m["bcc_addrs"].alias("bcc"), m["subject"].alias("subject"), m["date"].alias("date"), people.alias("participants")
    )
    skipped = F.struct(F.lit(True).alias("skipped"), emails.skip_reason(F.col("_kind")).alias("reason"))
    rest = typed.filter("_kind is null or _kind <> 'email'").select("doc_id", F.to_json(skipped).alias("outcome"))
    return parsed.select("doc_id", F.to_json(done).alias("outcome")).unionByName(rest)


def run_urls(docs: DataFrame) -> DataFrame:
    return urls.extract(docs, "doc_id", "full_text").select("doc_id", F.to_json(F.struct("urls", "urls_found")).alias("outcome"))


def entity_step(extractor=None):
    """The function of the entity step: names by pattern, those that ``extractor`` adds, and the participants of a mail."""

    def run(docs: DataFrame) -> DataFrame:
        found = entities.mentions(docs, "doc_id", "full_text")
        if extractor:
            found = entities.merged(found, entities.by_model(docs, "doc_id", "full_text", extractor), "doc_id")
        who = F.from_json(F.get_json_object(outcome("extract_email_metadata"), "$.participants"), "array<struct<name:string>>")
        people = docs.select("doc_id", F.explode(who).alias("p")).select("doc_id", F.col("p.name").alias("name"))
        columns = ["doc_id", "type", "text", "confidence", "method", "position_start", "position_end"]
        mail = entities.participants_as_people(found, people, "doc_id").filter("method = 'email'").withColumns({"position_start": F.lit(None).cast("int"), "position_end": F.lit(None).cast("int")})
        rows = found.select(*columns).unionByName(mail.select(*columns))
        name = F.struct(F.col("text").alias("name"), "confidence", "method", F.col("position_start").alias("start"), F.col("position_end").alias("end"))
        # A text's own names: their number is bounded by its length.
        lists = rows.groupBy("doc_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("type") == t, name)), _surer).alias(k) for k, t in KINDS.items()])
        all_docs = docs.select("doc_id").join(lists, "doc_id", "left")
        made = [F.coalesce(F.col(k), F.array().cast(_PLACED)).alias(k) for k in KINDS]
        total = sum((F.coalesce(F.size(F.col(k)), F.lit(0)) for k in KINDS), F.lit(0))
        return all_docs.select("doc_id", F.to_json(F.struct(F.when(F.col("persons").isNull(), 0).otherwise(total).alias("entities_found"), *made)).alias("outcome"))

    return run


def _surer(a: Column, b: Column) -> Column:
    """The surer name first, of equals the first in the text, then by code point."""
    def key(x: Column) -> Column:
        return F.struct(-x["confidence"], F.coalesce(x["start"], F.lit(2**31 - 1)), x["name"])

    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def run_assemble(docs: DataFrame) -> DataFrame:
    """The metadata of each document from the outcomes of the other steps; this step alone fills it."""
    get = lambda step, path: F.get_json_object(outcome(step), path)
    mail = {k: F.when(get("extract_email_metadata", "$.skipped") == "false", get("extract_email_metadata", f"$.{k}")) for k in ("from", "to", "cc", "subject", "date", "participants")}
    links = F.from_json(get("extract_urls", "$.urls"), "array<struct<url:string>>")
    fields = {"doc_type": get("classify", "$.doc_type"), "confidence": get("classify", "$.confidence"), "subtype": get("classify", "$.subtype"), **mail}
    fields["urls"] = F.to_json(F.transform(links, lambda u: u["url"]))
    fields["urls_count"] = get("extract_urls", "$.urls_found")
    for k, most in MOST.items():
        fields[k] = F.to_json(F.slice(F.transform(F.from_json(get("extract_entities", f"$.{k}"), "array<struct<name:string>>"), lambda x: x["name"]), 1, most))
    fields["entities_count"] = get("extract_entities", "$.entities_found")
    made = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[c.cast("string") for c in fields.values()])), lambda _, v: v.isNotNull())
    has = lambda step, path: F.coalesce(get(step, path).cast("int") > 0, F.lit(False))
    told = F.struct(
        F.size(made).alias("metadata_fields_assembled"), F.coalesce(get("extract_email_metadata", "$.skipped") == "false", F.lit(False)).alias("has_email_metadata"),
        has("extract_urls", "$.urls_found").alias("has_urls"), has("extract_entities", "$.entities_found").alias("has_entities"),
    )
    return docs.select("doc_id", F.to_json(told).alias("outcome"), made.alias("metadata"))


def all_steps(extractor=None) -> tuple[Step, ...]:
    """The steps of ``manifest.STEPS`` with their functions."""
    run = {"classify": run_classify, "extract_email_metadata": run_email, "extract_urls": run_urls, "extract_entities": entity_step(extractor), "assemble_metadata": run_assemble}
    return tuple(Step(s.name, s.version, s.depends_on, run[s.name]) for s in STEPS)
