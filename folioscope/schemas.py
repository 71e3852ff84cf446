"""Schemas of the stored tables and of the JSON files; nothing is inferred."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

S, L, D, I = StringType(), LongType(), DoubleType(), IntegerType()


def _of(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


DOCUMENTS = _of(doc_id=S, filepath=S, doc_type=S, confidence=D, line_count=I, full_text=S)
ENTITY_MENTIONS = _of(doc_id=S, entity_name=S)
ENTITIES = _of(entity_id=L, text=S, type=S, normalized_text=S, first_seen_doc_id=S, occurrence_count=L)
CANONICAL_ENTITIES = _of(canonical_id=L, entity_type=S, canonical_text=S, canonical_normalized=S, total_mentions=L, created_at=TimestampType(), updated_at=TimestampType())
ENTITY_ALIASES = _of(entity_id=L, canonical_id=L, is_canonical=BooleanType(), merge_method=S, merge_confidence=D, merged_at=TimestampType(), merged_by=S)
DOCUMENT_ENTITIES = _of(mention_id=L, doc_id=S, entity_id=L, context=S, confidence=D, method=S, position_start=I, position_end=I)
ADDRESS = _of(email=S, name=S)
THREAD_MESSAGE = _of(author=S, date_str=S, date=S, content_preview=S)
EMAIL = _of(
    from_addr=ADDRESS, to_addrs=ArrayType(ADDRESS), cc_addrs=ArrayType(ADDRESS), bcc_addrs=ArrayType(ADDRESS), subject=S, date=S, date_str=S, message_id=S, in_reply_to=S,
    references=ArrayType(S), reply_to=ADDRESS, is_reply=BooleanType(), is_forward=BooleanType(), body=S, signature=S, quoted_text=ArrayType(S), thread_messages=ArrayType(THREAD_MESSAGE),
    all_participants=ArrayType(S), parsing_issues=ArrayType(S), raw_headers=MapType(S, S),
)
CLASSIFICATION = _of(doc_id=S, filepath=S, file_size=L, line_count=L, document_type=S, confidence=D, entity_mentions=ArrayType(S), sample_lines=ArrayType(S), issues=ArrayType(S))
MERGE_CANDIDATE = _of(entity1_id=L, entity1_text=S, entity1_count=L, entity2_id=L, entity2_text=S, entity2_count=L, levenshtein=I, jaccard=D, confidence=D, reason=S)
STEP = _of(step_name=S, step_version=I, started_at=S, completed_at=S, status=S, outcome=S, error=S)
MANIFEST = _of(doc_id=S, original_file=S, created_at=S, updated_at=S, status=S, provenance=MapType(S, S), steps=ArrayType(STEP), metadata=MapType(S, S), error=S)
REPORT = _of(
    total_documents=L, total_size_mb=D, high_confidence_count=L, high_confidence_pct=D, total_issues=L,
    document_types=MapType(S, _of(documents=L, percentage=D)), entity_mentions=MapType(S, L),
)
