"""What operators leave in the driver's memory."""

from __future__ import annotations

from tallywell.llm import common, quality

from .fixtures import table


def test_the_parser_forgets_old_cascades(spark):
    """Rules come in another order each time; what the driver's parser keeps of them stays bounded."""
    docs = table(spark, [(1, "one two three"), (2, None)])
    rules = [*quality.BASE, *quality.RULES]
    parser = spark._jvm.org.apache.spark.sql.catalyst.parser.AbstractParser
    for k in range(3):
        assert quality.judged(docs, rules[k:] + rules[:k], sample_rows=1).where("rejected_by IS NULL").count() == 0
        assert spark.conf.get("spark.sql.parser.manageParserCaches") == "true"
        assert parser.getDFACacheNumStates() <= common.PARSER_STATES
