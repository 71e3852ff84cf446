"""The registered queries of the core; their SQL is in ``oracles``."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import urls as url_functions
from folioscope.operators import canonical, classify, emails, entities, legal, news, resolve, search, survey, timestamps
from folioscope.plans import api
from folioscope.plans.oracles import SQL
from folioscope.session import checkpoint_dir, cut, spread
from folioscope.sources import sinks
from folioscope.streaming import manifest, steps
from folioscope.tables import latest, table
from folioscope.text import lines, tokens

__all__ = ["QUERIES", "SQL"]

#: Seed terms of the survey's tagging.
SEEDS = {"Trust": r"\bTrust\b", "University": r"\bUniversity\b", "Subcommittee": r"\bSubcommittee\b", "Foundation": r"\bFoundations?\b", "Aviation": r"\b(?:Klopowiwen\s+)?Aviation\b"}
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark, d):
    return table(spark, d, "documents")


def texts(spark, d):
    """The documents for work on whole texts, spread over the cores where the scan has fewer partitions."""
    return spread(docs(spark, d))


def named(spark, d):
    """doc_id, entity_name of stored mentions."""
    return table(spark, d, "document_entities").select("doc_id", "entity_id").distinct().join(table(spark, d, "entities").select("entity_id", F.col("text").alias("entity_name")), "entity_id").select("doc_id", "entity_name").distinct()


def mails(spark, d):
    return latest(table(spark, d, "email_metadata"), ["doc_id"])


def mail_docs(spark, d):
    """The documents that the mail table lists, whatever their stored type."""
    return docs(spark, d).join(table(spark, d, "email_metadata").select("doc_id").distinct(), "doc_id", "left_semi")


def threads(spark, d):
    return latest(table(spark, d, "thread_messages"), ["doc_id", "message_index"])


# ---------------------------------------------------------------- timestamps


@query
def p5_found(spark, d):
    return timestamps.found(table(spark, d, "email_metadata"), table(spark, d, "thread_messages"), table(spark, d, "mail_domains"))


@query
def p5_status(spark, d):
    """All values of email_metadata.date with their instant and whether it was read, ambiguous or none."""
    rows = table(spark, d, "email_metadata").select("doc_id", "from_addr", "date").distinct()
    return timestamps.normalise(rows, "date", "from_addr", table(spark, d, "mail_domains"))


# ---------------------------------------------------------------- survey


@query
def scn_doc_id(spark, d):
    return docs(spark, d).select("doc_id", survey.doc_id(F.col("filepath")).alias("file_id"))


@query
def scn_scores(spark, d):
    return survey.scored(texts(spark, d)).select("doc_id", *[F.round(c, 9).alias(c) for c in ("mail_score", "narrative_score", "html_score")], "document_type", F.round("score", 9).alias("score"))


@query
def scn_seeds(spark, d):
    return docs(spark, d).select("doc_id", survey.seeds(F.col("full_text"), SEEDS).alias("seeds")).select("doc_id", F.explode("seeds").alias("seed"))


@query
def scn_sample_lines(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(survey.sample_lines(lines(F.col("full_text"))), "|").alias("sample"))


@query
def scn_issues(spark, d):
    return texts(spark, d).select("doc_id", F.explode(survey.issues(F.col("full_text"), lines(F.col("full_text")))).alias("issue"))


@query
def scn_classify(spark, d):
    c = survey.classify(texts(spark, d), SEEDS)
    return c.select("filepath", "file_size", "line_count", "document_type", F.round("confidence", 9).alias("confidence"), F.size("entity_mentions").alias("seeds"), F.size("issues").alias("issues"))


@query
def scn_types(spark, d):
    return survey.type_report(survey.classify(texts(spark, d), SEEDS))


@query
def scn_totals(spark, d):
    return survey.totals(survey.classify(texts(spark, d), SEEDS))


@query
def scn_mentions(spark, d):
    return survey.mention_counts(survey.classify(texts(spark, d), SEEDS))


@query
def scn_emails(spark, d):
    return survey.emails(survey.classify(texts(spark, d), SEEDS), 0.6).select("filepath", F.round("confidence", 9).alias("confidence"))


@query
def scn_report(spark, d):
    """The maps of the one-row report, as rows."""
    r = cut(survey.report(survey.classify(texts(spark, d), SEEDS)))
    types = r.select(F.lit("type").alias("section"), F.explode("document_types").alias("name", "v")).select("section", "name", F.col("v.documents").alias("n"))
    seeds = r.select(F.lit("seed").alias("section"), F.explode("entity_mentions").alias("name", "n"))
    return types.unionByName(seeds).unionByName(r.select(F.lit("total").alias("section"), F.lit("documents").alias("name"), F.col("total_documents").alias("n")))


# ---------------------------------------------------------------- structural classifier


@query
def cls_types(spark, d):
    return texts(spark, d).select("doc_id", classify.document_type(F.col("full_text")).alias("t")).select("doc_id", F.col("t.doc_type").alias("found_type"), F.round("t.confidence", 9).alias("confidence"), "t.subtype")


@query
def cls_histogram(spark, d):
    typed = texts(spark, d).select(classify.document_type(F.col("full_text"))["doc_type"].alias("found_type"))
    return classify.histogram(typed, "found_type")


@query
def cls_hybrid(spark, d):
    """With a scorer that stands for a model: it knows memoirs by their words."""

    def scorer(texts):
        return [("memoir", 0.8, "first person") if " I " in t or "Memoir" in t else ("other", 0.4, "") for t in texts]

    return classify.hybrid(texts(spark, d), "doc_id", "full_text", scorer)


# ---------------------------------------------------------------- entities


@query
def ent_mentions(spark, d):
    return entities.mentions(docs(spark, d), "doc_id", "full_text").drop("context")


@query
def ent_dates(spark, d):
    return entities.mentions(docs(spark, d), "doc_id", "full_text").filter("type = 'date'").select("doc_id", "text")


@query
def ent_locations(spark, d):
    return entities.mentions(docs(spark, d), "doc_id", "full_text").filter("type = 'location'").select("doc_id", "text")


@query
def ent_organizations(spark, d):
    return entities.mentions(docs(spark, d), "doc_id", "full_text").filter("type = 'organization'").select("doc_id", "text")


@query
def ent_normalised(spark, d):
    return table(spark, d, "entities").select("entity_id", entities.normalise(F.col("text"), F.col("type")).alias("normal"))


@query
def ent_table(spark, d):
    return entities.entity_table(entities.mentions(docs(spark, d), "doc_id", "full_text"), "doc_id")


@query
def ent_with_ids(spark, d):
    m = cut(entities.mentions(docs(spark, d), "doc_id", "full_text"))
    return entities.with_ids(m, entities.entity_table(m, "doc_id")).groupBy("entity_id").agg(F.count("*").alias("mentions"))


@query
def ent_contexts(spark, d):
    """Contexts cut again from the stored positions."""
    m = table(spark, d, "document_entities").filter("position_start is not null").select("mention_id", "doc_id", "position_start", "position_end").distinct()
    t = docs(spark, d).select("doc_id", "full_text")
    return m.join(t, "doc_id").select("mention_id", entities.context(F.col("full_text"), F.col("position_start"), F.col("position_end")).alias("around"))


@query
def ent_merged(spark, d):
    """Stored mentions of both methods, the surer of equal texts kept."""
    m = table(spark, d, "document_entities").join(table(spark, d, "entities").select("entity_id", "text", "type"), "entity_id").select("doc_id", "type", "text", "confidence", "method", F.col("mention_id").cast("int").alias("ordinal")).distinct()
    return entities.merged(m.filter("method = 'regex'"), m.filter("method = 'llm'"), "doc_id").select("doc_id", "type", F.lower(F.trim("text")).alias("name"), "confidence")


@query
def ent_by_model(spark, d):
    """With an extractor that stands for a model: it takes words before "University" for organisations."""
    import re

    def extractor(texts):
        return [[("organizations", m) for m in re.findall(r"\w+ University", t)] for t in texts]

    return entities.by_model(docs(spark, d), "doc_id", "full_text", extractor).drop("context")


@query
def ent_validated(spark, d):
    """Mentions under 0.8 of entities that one document only names are dropped, as a model's verdict would."""
    m = table(spark, d, "document_entities").join(table(spark, d, "entities").select("entity_id", "text", "type"), "entity_id").select("mention_id", "doc_id", "text", "type", "confidence").distinct()
    once = m.groupBy("text", "type").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("n")).filter("n = 1").select("doc_id", "text", "type", F.lit(False).alias("is_valid"))
    return entities.validated(m, once, "doc_id").select("mention_id", "doc_id", "confidence")


@query
def ent_participants(spark, d):
    m = table(spark, d, "document_entities").join(table(spark, d, "entities").select("entity_id", "text", "type"), "entity_id").select("doc_id", "type", "text", "confidence", "method")
    who = mails(spark, d).select("doc_id", F.explode(F.from_json("all_participants", "array<string>")).alias("p")).select("doc_id", F.trim(F.regexp_replace("p", r"\s*<[^>]*>", "")).alias("name"))
    return entities.participants_as_people(m, who, "doc_id").filter("method = 'email'").select("doc_id", "text")


# ---------------------------------------------------------------- URLs


def linked(spark, d):
    """Texts with URLs made of the stored addresses, as the test texts hold none."""
    m = mails(spark, d)
    url = F.concat(F.lit("https://"), F.lower(F.regexp_extract("from_addr", r"@([^>\s]+)", 1)), F.lit("/m/"), F.col("doc_id").cast("string"), F.when(F.col("is_reply") == 1, ".pdf").otherwise("?id=1"))
    return m.filter("from_addr like '%@%'").select("doc_id", F.concat(F.lit("See "), url, F.lit(" and HTTP://youtu.be/x then "), url).alias("text"))


@query
def url_extract(spark, d):
    return url_functions.extract(linked(spark, d), "doc_id", "text").select("doc_id", F.explode("urls").alias("u")).select("doc_id", "u.*")


@query
def url_types(spark, d):
    return url_functions.extract(linked(spark, d), "doc_id", "text").select(F.explode("urls").alias("u")).groupBy("u.type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- mails


@query
def eml_parsed(spark, d):
    return emails.metadata_rows(emails.parse(mail_docs(spark, d), "doc_id", "full_text"), "doc_id")


@query
def eml_headers(spark, d):
    m = F.col("mail")
    return emails.parse(mail_docs(spark, d), "doc_id", "full_text").select("doc_id", m["subject"].alias("subject"), m["message_id"].alias("message_id"), m["in_reply_to"].alias("in_reply_to"), m["date_str"].alias("date_str"))


@query
def eml_threads(spark, d):
    return emails.thread_rows(emails.parse(mail_docs(spark, d), "doc_id", "full_text"), "doc_id")


@query
def eml_attributions(spark, d):
    rows = emails.thread_rows(emails.parse(mail_docs(spark, d), "doc_id", "full_text"), "doc_id")
    return rows.select("doc_id", "message_index", "author", "date_str")


@query
def eml_quotes(spark, d):
    p = emails.parse(mail_docs(spark, d), "doc_id", "full_text")
    return p.select("doc_id", "mail.body", "mail.signature", F.array_join("mail.quoted_text", "\n\n").alias("quoted"))


@query
def eml_addresses(spark, d):
    return mails(spark, d).select("doc_id", emails.address(F.col("from_addr")).alias("a")).select("doc_id", "a.email", "a.name")


@query
def eml_clean(spark, d):
    return mails(spark, d).select("doc_id", emails.address(F.col("from_addr")).alias("a")).filter("a is not null").select("doc_id", emails.clean_email(F.col("a.email")).alias("email"), emails.clean_name(F.col("a.name")).alias("name"))


@query
def eml_flags(spark, d):
    return mails(spark, d).select("doc_id", emails.is_reply(F.col("subject"), F.col("in_reply_to")).alias("reply"), emails.is_forward(F.col("subject")).alias("forward"))


@query
def eml_participants(spark, d):
    split = lambda c: F.from_json(c, "array<string>")
    m = mails(spark, d)
    return m.select("doc_id", F.explode(emails.participants(F.array("from_addr"), split("to_addrs"), split("cc_addrs"))).alias("participant"))


@query
def eml_skips(spark, d):
    return docs(spark, d).select("doc_id", emails.skip_reason(F.col("doc_type")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- legal and news


@query
def leg_fields(spark, d):
    listed = {c: F.array_join(c, "|") for c in ("plaintiffs", "defendants")}
    return legal.parse(texts(spark, d), "doc_id", "full_text").drop("body").withColumns(listed | {"filing_date": F.col("filing_date").cast("string")})


@query
def leg_body(spark, d):
    return legal.parse(texts(spark, d), "doc_id", "full_text").select("doc_id", "body")


@query
def leg_attorneys(spark, d):
    """Sections made of the senders' names, as the test texts hold none."""
    name = F.trim(F.regexp_replace("from_addr", r"\s*<[^>]*>", ""))
    parts = [F.lit("Attorneys for Plaintiff:"), F.concat(name, F.lit(" Example Law LLP Bar No. "), F.col("doc_id").cast("string")), F.lit(""), F.lit("Attorney for Defendants"), F.concat(F.lit("Ann Sample Attorney for the firm of "), name), F.concat(name, F.lit(" , Other Firm Bar No. 7"))]
    m = mails(spark, d).filter("from_addr is not null").select("doc_id", F.concat_ws("\n", *parts).alias("t"))
    return m.select("doc_id", F.explode(legal.attorneys(F.col("t"))).alias("a")).select("doc_id", "a.*")


@query
def nws_fields(spark, d):
    return news.parse(texts(spark, d), "doc_id", "full_text").select("doc_id", "publication", "section", "article_type")


@query
def nws_body(spark, d):
    return news.parse(texts(spark, d), "doc_id", "full_text", loose=True).select("doc_id", "author", "headline", "publication_date_str", "body", "summary")


# ---------------------------------------------------------------- similar entities


@query
def sim_pairs(spark, d):
    return resolve.candidates(table(spark, d, "entities"), table(spark, d, "entity_aliases"), None, 2).withColumns({"jaccard": F.round("jaccard", 9), "confidence": F.round("confidence", 9)}).drop("reason")


@query
def sim_reasons(spark, d):
    return resolve.candidates(table(spark, d, "entities"), table(spark, d, "entity_aliases"), "person", 2).select("entity1_id", "entity2_id", "reason")


@query
def sim_top(spark, d):
    return resolve.top(resolve.candidates(table(spark, d, "entities"), table(spark, d, "entity_aliases"), "person", 2), 25).select("entity1_id", "entity2_id", F.round("confidence", 9).alias("confidence"))


@query
def sim_tiers(spark, d):
    return resolve.tier_counts(resolve.tiers(resolve.candidates(table(spark, d, "entities"), table(spark, d, "entity_aliases"), None, 2), 200))


@query
def sim_report(spark, d):
    """The arrays of the one-row report, as rows."""
    r = cut(resolve.report(resolve.tiers(resolve.candidates(table(spark, d, "entities"), table(spark, d, "entity_aliases"), None, 2), 200)))
    tiers = [r.select(F.lit(t).alias("tier"), F.posexplode(t).alias("place", "p")) for t in ("auto_merge", "llm_review", "manual_review")]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).select("tier", "place", "p.entity1_id", "p.entity2_id", F.round("p.confidence", 9).alias("confidence"))


# ---------------------------------------------------------------- canonical records


@query
def can_initial(spark, d):
    return canonical.initialise(table(spark, d, "entities"))[0].drop("created_at", "updated_at")


@query
def can_of_entity(spark, d):
    return canonical.of_entity(table(spark, d, "entity_aliases"), table(spark, d, "canonical_entities")).select("entity_id", "canonical_id", "canonical_text")


@query
def can_aliases(spark, d):
    return canonical.aliases_of(table(spark, d, "entity_aliases"), table(spark, d, "entities"))


@query
def can_search(spark, d):
    c = canonical.current(table(spark, d, "canonical_entities"))
    return c.filter(search.prefix_phrase(F.col("canonical_text"), "Orsolina V") | search.prefix_phrase(F.col("canonical_text"), "patric")).select("canonical_id", "canonical_text", "total_mentions")


@query
def can_merge(spark, d):
    """Every entity under 3 occurrences moved to the record of entity 1, if it has one, with the totals counted again."""
    a, e = table(spark, d, "entity_aliases"), table(spark, d, "entities")
    target = a.filter("entity_id = 1 and canonical_id is not null").agg(F.min("canonical_id").alias("target"))
    moves = e.filter("occurrence_count < 3").select("entity_id", F.lit(0.9).alias("confidence")).join(F.broadcast(target))  # one row
    merged = canonical.merge(a, moves.filter("target is not null"))
    return canonical.totals(canonical.current(table(spark, d, "canonical_entities")), merged, e).select("canonical_id", "total_mentions")


@query
def can_auto_merge(spark, d):
    e, a = table(spark, d, "entities"), table(spark, d, "entity_aliases")
    pairs = resolve.ordered(resolve.top(resolve.candidates(e, a, None, 2), 200))
    _, log = canonical.auto_merge(pairs, a, 0.85)
    return log


@query
def can_stats(spark, d):
    return canonical.stats(table(spark, d, "canonical_entities"), table(spark, d, "entity_aliases"))


@query
def can_by_type(spark, d):
    return canonical.by_type(table(spark, d, "canonical_entities"))


@query
def can_most_aliases(spark, d):
    return canonical.most_aliases(table(spark, d, "canonical_entities"), table(spark, d, "entity_aliases"))


@query
def can_review(spark, d):
    pairs = resolve.top(resolve.candidates(table(spark, d, "entities"), table(spark, d, "entity_aliases"), None, 2), 200)
    cases = canonical.review_cases(pairs, table(spark, d, "document_entities"))
    return canonical.reviewed(cases, lambda a, b, ca, cb: (a.split()[-1] == b.split()[-1], "last words")).select("entity1_id", "entity2_id", "should_merge", "note")


# ---------------------------------------------------------------- search


@query
def fts_terms(spark, d):
    p = search.postings(texts(spark, d), "doc_id", "full_text")
    return p.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("uses"))


@query
def fts_lengths(spark, d):
    return search.lengths(texts(spark, d), "doc_id", "full_text")


def _ranked(spark, d, text):
    return search.ranked_texts(texts(spark, d), "doc_id", "full_text", text).select("doc_id", F.round("rank", 6).alias("rank"))


@query
def fts_word(spark, d):
    return _ranked(spark, d, "donation")


@query
def fts_boolean(spark, d):
    return _ranked(spark, d, "(donation OR subpoena) AND harbor NOT envelope")


@query
def fts_phrase(spark, d):
    return _ranked(spark, d, '"mining permit" voucher')


@query
def fts_prefix(spark, d):
    return _ranked(spark, d, "photogr*")


@query
def fts_search(spark, d):
    found = search.search_texts(texts(spark, d).select("doc_id", "filepath", "full_text"), "insurance adjuster", 20)
    return found.select("doc_id", "filepath", F.round("rank", 6).alias("rank"))


@query
def fts_snippets(spark, d):
    return search.search_texts(texts(spark, d).select("doc_id", "filepath", "full_text"), "insurance adjuster", 20).select("doc_id", "snippet")


@query
def fts_indexed(spark, d):
    """The boolean query on a stored index, half of whose documents came as a later part."""
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    dd = texts(spark, d)
    search.write_index(dd.filter("doc_id % 2 = 0"), "doc_id", "full_text", path)
    search.update_index(dd.filter("doc_id % 2 = 1"), "doc_id", "full_text", path, "p1")
    return search.ranked(*search.read_index(spark, path), "(donation OR subpoena) AND harbor NOT envelope").select("doc_id", F.round("rank", 6).alias("rank"))


# ---------------------------------------------------------------- operations


@query
def api_document(spark, d):
    return api.get_document(docs(spark, d), named(spark, d), 3).select("doc_id", "filepath", "doc_type", F.array_join("entities", "|").alias("entities"))


@query
def api_by_entity(spark, d):
    return api.find_by_entity(docs(spark, d), named(spark, d), "Orsolina Vantreekel", 50).select("doc_id", "filepath", "doc_type", "confidence")


@query
def api_entities(spark, d):
    return api.list_entities(named(spark, d))


@query
def api_stats(spark, d):
    return api.document_stats(docs(spark, d), named(spark, d))


@query
def api_entity_mentions(spark, d):
    return api.entity_mentions(table(spark, d, "entities"), table(spark, d, "document_entities"), docs(spark, d), "patricia", "person", 5).select("entity_id", "text", "doc_id", "confidence", "place")


@query
def api_threads(spark, d):
    return api.email_threads(threads(spark, d), docs(spark, d), mails(spark, d), "patricia", 200).select("doc_id", "message_index", "author", "date", "subject")


@query
def api_dead_letters(spark, d):
    return api.dead_letters(mails(spark, d), docs(spark, d), 50).select("doc_id", "filepath", F.array_join("issues", "|").alias("issues"))


@query
def api_list_emails(spark, d):
    return api.list_emails(survey.classify(texts(spark, d), SEEDS), 0.6, "Trust").select("filepath", F.round("confidence", 9).alias("confidence"))


# ---------------------------------------------------------------- relational forms


@query
def rel_point(spark, d):
    return docs(spark, d).filter("doc_id = 5").select("doc_id", "doc_type", "line_count")


@query
def rel_in_list(spark, d):
    return docs(spark, d).filter(F.col("doc_id").isin(1, 7, 42, 99)).select("doc_id", "doc_type")


@query
def rel_range(spark, d):
    return table(spark, d, "entity_aliases").filter(F.col("merge_confidence").between(0.8, 0.95)).select("entity_id", "canonical_id", "merge_confidence").distinct()


@query
def rel_conjunction(spark, d):
    a = table(spark, d, "entity_aliases").filter("is_canonical").select("entity_id").distinct()
    return table(spark, d, "entities").filter("type = 'person' and occurrence_count >= 5").join(a, "entity_id").select("entity_id", "text")


@query
def rel_join_mentions(spark, d):
    m = table(spark, d, "document_entities").select("mention_id", "doc_id", "entity_id").distinct()
    return m.join(docs(spark, d).select("doc_id", "doc_type"), "doc_id").groupBy("doc_type").agg(F.count("*").alias("mentions"), F.countDistinct("entity_id").alias("entities"))


@query
def rel_left_join(spark, d):
    t = threads(spark, d).join(docs(spark, d).select("doc_id", "doc_type"), "doc_id")
    return t.join(mails(spark, d).select("doc_id", "subject"), "doc_id", "left").groupBy("doc_type").agg(F.count("*").alias("messages"), F.count("subject").alias("with_subject"))


@query
def rel_semi_join(spark, d):
    e = table(spark, d, "entities").filter("type = 'organization'")
    return table(spark, d, "document_entities").join(e, "entity_id", "left_semi").groupBy("method").agg(F.countDistinct("mention_id").alias("mentions"))


@query
def rel_anti_join(spark, d):
    return table(spark, d, "entities").join(table(spark, d, "entity_aliases"), "entity_id", "left_anti").select("entity_id", "text")


@query
def rel_counts(spark, d):
    return docs(spark, d).groupBy("doc_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.sum("line_count").alias("line_total"))


@query
def rel_batch_counters(spark, d):
    m = table(spark, d, "document_entities")
    return m.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("mention_id").alias("mentions"), F.count_if(F.col("context").isNull()).alias("without_context"), F.count_if(F.col("method") == "llm").alias("by_model"))


@query
def rel_lists(spark, d):
    m = table(spark, d, "document_entities").select("doc_id", "entity_id").distinct()
    return m.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("entity_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query
def rel_top_per_group(spark, d):
    m = table(spark, d, "document_entities").select("mention_id", "entity_id", "doc_id", "confidence").distinct()
    place = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("confidence"), "doc_id", "mention_id"))
    return m.withColumn("place", place).filter("place <= 3")


@query
def rel_one_context(spark, d):
    return table(spark, d, "document_entities").filter("context is not null").groupBy("entity_id").agg(F.min_by("context", "mention_id").alias("context"))


@query
def rel_latest(spark, d):
    return mails(spark, d).select("doc_id", "from_addr", "subject", "date")


@query
def rel_token_sets(spark, d):
    e = table(spark, d, "entities").filter("type = 'organization'")
    t = lambda c: F.array_distinct(tokens(F.coalesce(c, F.lit(""))))
    return e.select("entity_id", F.size(F.array_intersect(t("text"), t("normalized_text"))).alias("shared"), F.size(F.array_union(t("text"), t("normalized_text"))).alias("either"))


# ---------------------------------------------------------------- writing and pipeline


@query
def snk_upsert(spark, d):
    c = table(spark, d, "canonical_entities")
    old = c.groupBy("canonical_id").agg(F.min("total_mentions").alias("total_mentions"))
    new = c.filter("entity_type = 'person' and total_mentions is not null").select("canonical_id", (F.col("total_mentions") + 1000).alias("total_mentions")).distinct()
    return sinks.upsert(old, new, ["canonical_id"], "total_mentions")


@query
def snk_ignore(spark, d):
    """Pairs of document and entity named by patterns, with those named by a model that are not there yet."""
    m = table(spark, d, "document_entities")
    return sinks.insert_or_ignore(m.filter("method = 'regex'").select("doc_id", "entity_id").distinct(), m.filter("method = 'llm'").select("doc_id", "entity_id"), ["doc_id", "entity_id"]).groupBy("entity_id").agg(F.count("*").alias("documents"))


@query
def snk_entities(spark, d):
    """Every normal form seen once more, and one that is new for each."""
    key = ["normalized_text", "type"]
    e = table(spark, d, "entities").filter("normalized_text is not null").groupBy(*key).agg(F.min(F.struct("entity_id", "text", "first_seen_doc_id", "occurrence_count")).alias("r")).select(*key, "r.*")
    seen = e.select(*key, "text", F.col("entity_id").alias("doc_id")).unionByName(e.select(F.concat(F.col("normalized_text"), F.lit(" x")).alias("normalized_text"), "type", "text", F.col("entity_id").alias("doc_id")))
    made = sinks.entity_upsert(e.select("entity_id", "text", "type", "normalized_text", "first_seen_doc_id", "occurrence_count"), seen)
    return made.groupBy("type").agg(F.count("*").alias("entities"), F.sum("occurrence_count").alias("occurrences"), F.countDistinct("entity_id").alias("ids"))


@query
def snk_load(spark, d):
    c = docs(spark, d).select("filepath").distinct()
    files = docs(spark, d).filter("full_text <> ''").groupBy("filepath").agg(F.max("full_text").alias("full_text"))
    return sinks.counters(sinks.load_status(c, files))


@query
def pip_steps(spark, d):
    """Documents taken through two steps; then the first one's version changes and its dependents' results go."""
    dd = texts(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "filepath", "full_text")
    by_name = {s.name: s for s in steps.all_steps()}
    first, second = by_name["classify"], by_name["extract_email_metadata"]
    m = manifest.create(dd, "doc_id", "filepath", "t0")
    m = cut(manifest.run_step(cut(manifest.run_step(m, dd, first, "t1")), dd, second, "t2"))
    done = m.select("doc_id", F.size("steps").alias("steps_before"))
    m = manifest.run_step(m, dd, manifest.Step("classify", 3, (), first.run), "t3")
    last = manifest.last_step(F.col("steps"))
    return m.join(done, "doc_id").select("doc_id", "status", "steps_before", F.size("steps").alias("steps"), last["step_version"].alias("version"), F.get_json_object(last["outcome"], "$.doc_type").alias("found_type"))


@query
def pip_metadata(spark, d):
    """All five steps over all documents: the type and numbers that the last one put together."""
    dd = texts(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "filepath", "full_text")
    m = manifest.run_all(manifest.create(dd, "doc_id", "filepath", "t0"), dd, steps.all_steps(), "t1")
    get = lambda k: F.col("metadata")[k]
    return m.select("doc_id", "status", get("doc_type").alias("doc_type"), get("subject").alias("subject"), get("urls_count").cast("int").alias("urls"), get("entities_count").cast("int").alias("entities"))


@query
def pip_assembled(spark, d):
    dd = docs(spark, d)
    m = table(spark, d, "document_entities").join(table(spark, d, "entities").select("entity_id", "text", "type"), "entity_id").select("doc_id", "type", "text", "confidence").groupBy("doc_id", "type", "text").agg(F.max("confidence").alias("confidence"))
    u = url_functions.extract(texts(spark, d), "doc_id", "full_text").select("doc_id", "urls")
    out = manifest.assemble(dd.select("doc_id", "doc_type"), m, u, mails(spark, d).select("doc_id", "subject"))
    return out.select("doc_id", "doc_type", F.array_join("urls", "|").alias("urls"), F.array_join("people", "|").alias("people"), F.array_join("organizations", "|").alias("organizations"), F.array_join("locations", "|").alias("locations"), "mentions", "subject")
