import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.functions.stem import stem
from brindle.functions.text import tokenize_query
from brindle.plans import ast
from brindle.plans.ast import show
from brindle.plans.compiler import compile_node, compile_query, phrase_documents
from brindle.plans.parser import QueryParseError, parse

GOLDEN = {
    "alpha OR beta gamma": "AND(OR(Term(alpha), Term(beta)), Term(gamma))",
    "alpha AND beta OR gamma": "OR(AND(Term(alpha), Term(beta)), Term(gamma))",
    "alpha NEAR/3 beta AND gamma": "AND(NEAR/3(Term(alpha), Term(beta)), Term(gamma))",
    "near\\2 alpha": None,
    "NOT alpha beta": "AND(NOT(Term(alpha)), Term(beta))",
    "the alpha": "Term(alpha)",
    "alpha) beta": "Term(alpha)",
    '"open phrase here': 'Phrase("open phrase here")',
    "alpha NEAR/\u06f3 beta": "AND(AND(Term(alpha), Term(near)), Term(beta))",
    "alpha NEAR/x beta": "AND(AND(Term(alpha), Term(near)), Term(beta))",
    "foo:bar": 'Phrase("foo bar")',
    "title:foo*": "Field(title:foo*)",
    "TITLE:Foo": "Field(title:foo)",
    "al?ha*": "Wildcard(al?ha*)",
    "alpha NEAR beta NEAR/2 gamma": "NEAR/2(NEAR/1(Term(alpha), Term(beta)), Term(gamma))",
    "(alpha OR beta) and not gamma": "AND(OR(Term(alpha), Term(beta)), NOT(Term(gamma)))",
    "": "(empty)",
    "the": "(empty)",
}


@pytest.mark.parametrize("query,tree", [(q, t) for q, t in GOLDEN.items() if t is not None])
def test_trees(query, tree):
    assert show(parse(query)) == tree


@pytest.mark.parametrize(
    "query,position,message",
    [
        ("alpha AND the", 13, "after AND"), ("(alpha beta)", 7, "closing parenthesis"), ("NOT NOT alpha", 4, "Unexpected token: Not"), ("alpha OR", 8, "after OR"),
        ("the AND alpha", 4, "Unexpected token: And"), ("alpha NEAR", 10, "after NEAR"), ("NOT", 3, "after NOT"), ("(alpha", 6, "closing parenthesis"),
    ],
)
def test_errors(query, position, message):
    with pytest.raises(QueryParseError, match=message) as e:
        parse(query)
    assert e.value.position == position


DOCS = [
    (1, "alpha beta", "gamma delta alpha", "one.txt"), (2, "", "beta gamma", "two.md"), (3, "delta", "alpha beta gamma alpha beta", None), (4, "", "", "alpha.txt"),
    (5, None, None, None), (6, "running dogs", "the alpha runs and alpha ran", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, title string, content string, file_name string").cache()


def brute(node, doc, form=lambda w: w):
    doc_id, title, content, name = doc
    fields = {"title": tokenize_query(title), "content": tokenize_query(content), "filename": tokenize_query(name)}
    tokens = [form(t) for t in fields["title"] + fields["content"]]

    def starts(words):
        words = [form(w) for w in words]
        return [i for i in range(len(tokens) - len(words) + 1) if tokens[i : i + len(words)] == words]

    match node:
        case ast.Term(w):
            return form(w) in tokens
        case ast.Phrase(ws):
            return bool(starts(ws))
        case ast.Field(f, w):
            return w in fields[f]
        case ast.Not(x):
            return not brute(x, doc, form)
        case ast.And(a, b):
            return brute(a, doc, form) and brute(b, doc, form)
        case ast.Or(a, b):
            return brute(a, doc, form) or brute(b, doc, form)
        case ast.Near(a, b, d):
            sides = [x.words if isinstance(x, ast.Phrase) else (x.word,) if isinstance(x, ast.Term) else () for x in (a, b)]
            if not all(sides):
                return False
            ends = [i + len(sides[0]) - 1 for i in starts(sides[0])]
            return any(abs(q - p) - 1 <= d for p, q in itertools.product(ends, starts(sides[1])))
    raise AssertionError(node)


words = st.sampled_from(["alpha", "beta", "gamma", "delta", "zeta"])
leaves = st.one_of(
    words.map(ast.Term), st.lists(words, min_size=2, max_size=3).map(lambda w: ast.Phrase(tuple(w))),
    st.tuples(st.sampled_from(["title", "content", "filename"]), words).map(lambda t: ast.Field(*t)),
    st.tuples(words, words, st.integers(-1, 3)).map(lambda t: ast.Near(ast.Term(t[0]), ast.Term(t[1]), t[2])),
)
trees = st.recursive(leaves, lambda c: st.one_of(c.map(ast.Not), st.tuples(c, c).map(lambda t: ast.And(*t)), st.tuples(c, c).map(lambda t: ast.Or(*t))), max_leaves=5)


@settings(max_examples=15, deadline=None)
@given(trees)
def test_plans_against_brute_force(docs, node):
    got = {r[0] for r in compile_node(docs, node).collect()}
    assert got == {d[0] for d in DOCS if brute(node, d)}


@pytest.mark.parametrize("query", ["run AND dog", "NOT run", '"running dogs"', "dogs NEAR/1 runs"])
def test_stems(docs, query):
    got = {r[0] for r in compile_query(docs, query, "stem").collect()}
    assert got == {d[0] for d in DOCS if brute(parse(query), d, stem)}


def test_mixed_does_not_stem_the_query(docs):
    assert compile_query(docs, "running", "mixed").collect() == []
    assert [r[0] for r in compile_query(docs, "run", "mixed").collect()] == [6]


def test_wildcards_and_empty(docs):
    assert {r[0] for r in compile_query(docs, "alph*").collect()} == {1, 3, 6}
    assert {r[0] for r in compile_query(docs, "?eta").collect()} == {1, 2, 3}
    assert compile_query(docs, "the").collect() == []
    assert compile_query(docs, "(alpha NEAR beta) NEAR gamma").collect() == []
    assert {r[0] for r in phrase_documents(docs, ["beta", "gamma"]).collect()} == {1, 2, 3}


def test_index_gives_the_same(docs, spark):
    from brindle.operators.index import postings

    index = postings(docs)
    for q in ("alpha AND NOT beta", '"beta gamma" OR title:delta', "alph* NEAR beta", "filename:alpha OR NOT alpha"):
        for analyzer in ("raw", "stem"):
            assert {r[0] for r in compile_query(docs, q, analyzer, index).collect()} == {r[0] for r in compile_query(docs, q, analyzer).collect()}, (q, analyzer)


def test_plan_has_one_shuffle_and_no_cartesian(docs, spark):
    plan = compile_query(docs, "(alpha OR beta) AND gamma AND title:delta")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan
    assert plan.count("Generate") == 1
