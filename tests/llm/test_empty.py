"""Empty tables."""

from tracelake.llm import language_id, token_files
from tracelake.llm.common import stage_path


def test_no_documents_no_tokens(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    path = stage_path(spark, "no-tokens")
    token_files.write_token_files(none, path)
    assert token_files.count_tokens(spark, path, trailer=token_files.TRAILER).count() == 0


def test_no_rows_no_languages(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert language_id.keep_identified(none).count() == 0
    assert language_id.identify(language_id.document_rows(none), ["doc_id"], language_id.fit_documents(none)).count() == 0
