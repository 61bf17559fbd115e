import pytest

from weftgraph import registry
from weftgraph.operators import enrichment as E

SF = "/root/testdata/sf0.001"


def test_settings_ask_for_what_is_used():
    none = E.Settings.read({})
    assert none.lacking() == ["LLM_API_KEY is required", "EMBEDDING_API_KEY is required", "PROJECT_ROOT is required"]
    assert none.lacking(llm=False) == ["EMBEDDING_API_KEY is required", "PROJECT_ROOT is required"]
    full = E.Settings.read({"LLM_API_KEY": "a", "EMBEDDING_API_KEY": "b", "PROJECT_ROOT": "/p", "EMBEDDING_DIMENSION": "8", "MAX_TOKENS_PER_CHUNK": "50"})
    assert full.lacking() == [] and (full.embedding.dimension, full.chunk_tokens, full.project) == (8, 50, "default")
    assert "'a'" not in repr(full)


@pytest.mark.parametrize("usage", [{}, {"usage": None}])
def test_responses_may_lack_their_usage(usage):
    assert E.vector_of({"data": [{"embedding": [1, 2]}], **usage}) == ([1.0, 2.0], None)
    assert E.vector_of({"data": [{"embedding": [1]}], "usage": {"total_tokens": 3}}) == ([1.0], {"total_tokens": 3})


def test_run_skips_fails_and_counts(spark):
    prompts = spark.createDataFrame([("a", "x", 5, 0.3), ("b", "bad", 5, 0.3), ("c", "", 5, 0.3), ("d", "y", 7, 0.3)], "id string, prompt string, max_tokens int, temperature double")
    done = spark.createDataFrame([("d",), ("d",), ("z",)], "id string")

    def explain(prompt, most, heat):
        if prompt == "bad":
            raise RuntimeError("no service")
        return prompt and f"{prompt} {most} {heat}"

    out = E.run(prompts, done, explain, lambda t: [len(t)])
    assert sorted((r.id, r.explanation, r.status, r.error) for r in out.collect()) == [
        ("a", "x 5 0.3", "done", None), ("b", None, "failed", "no service"), ("c", None, "failed", "empty explanation"), ("d", None, "skipped", None),
    ]
    assert E.totals(out).first().asDict() == {"total": 4, "done": 1, "failed": 2, "skipped": 1}
    assert E.totals(E.run(prompts, done, explain, lambda t: [1], force=True)).first().done == 2


def test_entries_are_found_every_way(spark):
    got = registry.entries()["flow_entry_methods"](spark, SF).groupBy("found_by").count().collect()
    assert {r.found_by for r in got} >= {"edge", "method"}


def test_walk_goes_nearest_first(spark):
    class G:
        flows = spark.createDataFrame([("f", "m"), ("g", "hub"), ("h", None)], "flow_id string, method_node_id string")
        uses = spark.createDataFrame([("m", "z"), ("m", "m"), ("z", "a"), ("a", "m"), ("a", "b"), ("b", "c")] + [("hub", f"u{i:02}") for i in range(40)] + [("u00", "deep")], "source_id string, target_id string")
        of_type = lambda self, *types: self.uses
        keep = staticmethod(lambda df, name, *by: df)

    got = {(r.flow_id, r.k): r.node_id for r in E.flow_walk(G()).collect()}
    assert [got["f", k] for k in (1, 2, 3)] == ["z", "a", "b"] and ("f", 4) not in got
    assert [got["g", k] for k in range(1, 13)] == [f"u{i:02}" for i in range(12)] and ("g", 13) not in got
    assert {f for f, _ in got} == {"f", "g"}
