"""The clause path decides over a fitted grammar's stems."""

from citeflow.llm import common, toxicity

SF = "/root/testdata/sf0.01"


def test_clause_path_outweighs_learnt_stems(spark):
    grammar = toxicity.fit(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"))
    seeds = {*toxicity.INSULTS, *toxicity.THREATS}
    learnt = max((k for k in grammar.insults if k not in seeds), key=grammar.insults.get).rstrip("$")
    assert grammar.insults.get(learnt, grammar.insults.get(learnt + "$")) > 4.5
    assert grammar.score(f"you are {learnt}") > 0.5 and grammar.score(f"all this {learnt} here") > 0.5
    for clean in (f"never {learnt}", f"it is not in any way or sense or manner {learnt}", f"she wrote that all of the others there were {learnt}", f"he said you are {learnt} and {learnt}"):
        assert grammar.score(clean) < 0.5, clean
    assert grammar.score(f"this is not good, you {learnt}") > 0.5
    assert grammar.score("i will kill you") > 0.5 > grammar.score("they never kill you") and grammar.score("a way to kill weeds") < 0.5
