import random

import numpy as np
from pyspark.sql import functions as F

from pagecrest.llm import toxicity as X
from pagecrest.llm.common import bucket_of_id

LEXICON = X.Lexicon({"idiot": 5.0}, {"lowei": 3.0})


def paths(text):
    return [(p, w) for _, _, p, w in LEXICON.evidence(text)[1]]


#: Sentences with "idiot" and words in "lowei", and the paths of what they say, in order.
CASES = [
    ("What an idiot.", "plain"), ("You are an IDIOT. Fine.", "targeted"), ("Never an idiot.", "negated"), ("idiot idiot", "plain"), ("nothing here", ""), ("", ""),
    ("you are not really such a complete idiot", "negated"), ("not clever, an idiot", "plain"), ("Not mad but an idiot.", "plain"), ("you aren't an idiot", "negated"), ("No. An idiot.", "plain"),
    ("he said: you idiot", "reported"), ('The paper said "idiot" twice.', "reported"), ("You said. What an idiot.", "plain"), ("she called him an idiot", "reported"), ("she never called him an idiot", "reported"),
    ('"hello" she is fine, you idiot', "targeted"), ('"First part. Then idiot. And idiot again." Out, idiot.', "reported reported plain"), ('He wrote "idiot" and you idiot', "reported targeted"), ('an open " quote\nyou idiot', "targeted"),
    ("idiot, you", "targeted"), ("idiot, he is", "plain"), ("An idiot. You are fine.", "plain"), ("idiot and you idiot", "targeted"), ("they are idiot people", "targeted"),
    ("I will kill you.", "threat"), ("i want to kill you", "threat"), ("I will not kill you.", ""), ("we are going to be killing them", "threat"), ("he said i will kill you", ""), ("I will go. Kill you.", ""), ("I will go out with her and then they beat him", ""),
    ("you will idiot kill them", "targeted threat"),
    ("Du bist ein idiot", "targeted"), ("Kein idiot.", "negated"), ("Er sagte: du idiot!", "reported"), ("„Du idiot“, rief sie. Du idiot.", "reported targeted"), ("Ich werde dich töten", "threat"), ("je vais te frapper", "threat"), ("Ich werde töten euch", "threat"), ("Das ist loweiisch; idiotic", "plain"),
    ("Tu es un idiot", "targeted"), ("Tu n'es pas un idiot", "negated"), ("il a dit: quel idiot", "reported"), ("« idiot » puis idiot", "reported plain"), ("je vais tuer vous", "threat"), ("idiot, toi !", "targeted"),
    ("Eres un idiot, tú", "targeted"), ("No eres idiot", "negated"), ("dijo que es idiot", "reported"), ("voy a matar a ellos", "threat"), ("nunca voy a matar a ellos", ""),
]


def test_written_cases():
    for text, want in CASES:
        got = sorted(p for p, _ in paths(text))
        assert got == sorted(want.split()), (text, got)
    assert paths("idiot idiot") == [("plain", 10.0)] and paths("Das ist loweiisch; idiotic") == [("plain", 3.0)]
    assert paths("I will kill you.") == [("threat", X.THREAT)]


def by_rules(symbols):
    """What the four transducers say, by looking back over the whole sequence at every symbol."""
    out = []
    for k, s in enumerate(symbols):
        before = symbols[:k]
        line = before[before.rfind("P") + 1 :]
        quoted = line.count("Q") % 2 == 1
        speech = line[line.rfind("Q") + 1 :]  # a quotation's end ends the speech before it
        reported = quoted or "R" in speech[speech.rfind("S") + 1 :]
        clause = before[max(before.rfind(x) for x in "CKSP") + 1 :]
        if s in "IH" and reported:
            out.append("r" if s == "I" else "O")
        elif s in "IH" and "N" in clause:
            out.append("i" if s == "I" else "O")
        else:
            out.append(s)
    seen = waiting = False
    for k, s in enumerate(out):
        if s in "SP":
            seen = waiting = False
        elif s == "I" and seen:
            out[k] = "j"
        elif s == "I":
            waiting = True
        elif s == "Y" and waiting:
            out[k], seen, waiting = "U", True, False
        elif s in "TY" and not waiting:
            seen = True
    intent = harm = None
    for k, s in enumerate(out):
        if s in "CKSP":
            intent = harm = None
        elif s == "M":
            intent, harm = k, None
        elif s == "H" and intent is not None and harm is None and k - intent <= X.NEAR + 1:
            harm = k
            if any(x in "TYU" for x in out[intent:k]):
                out[k], intent, harm = "X", None, None
        elif s in "TYU" and harm is not None and k - harm <= X.NEXT + 1:
            out[k], intent, harm = "X", None, None
    return "".join(out)


def test_machine_against_rules_and_its_parts():
    rng, machine, parts = random.Random(6), X.grammar(), X.grammar_parts()
    for _ in range(20_000):
        symbols = "".join(rng.choice(X.SYMBOLS + "IOOYM") for _ in range(rng.randint(0, 14)))
        state, one = 0, ""
        for s in symbols:
            o, state = machine.step(state, s)
            one += o
        two = symbols
        for part in parts:
            state, out = 0, ""
            for s in two:
                o, state = part.step(state, s)
                out += o
            two = out
        assert one == two == by_rules(symbols), symbols


def test_composition_is_application_in_turn():
    upper = X.Transducer({(0, "a"): ("b", 1), (1, "a"): ("a", 0)})
    swap = X.Transducer({(0, "b"): ("c", 0)})
    both = X.compose(upper, swap, "abc")
    state, out = 0, []
    for s in "aabca":
        o, state = both.step(state, s)
        out.append(o)
    assert out == ["c", "a", "c", "c", "c"]


def test_clause_spans(spark):
    model = X.Model(LEXICON, -3.0, np.ones(X.N_EVIDENCE))
    got = X.with_clauses(spark.createDataFrame([("Hello. You idiot! Bye",), (None,)], "text string"), model).collect()
    text, spans = got[0]["text"], got[0]["clauses"]
    assert [text[s["start"] : s["end"]].strip() for s in spans] == ["You idiot"] and got[1]["clauses"] == []


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = bucket_of_id(F.col("doc_id"), 5) == 0
    scored = X.with_score(docs, X.learn(docs, labels, ~held)).where(held).join(labels, "doc_id")
    hit, toxic, false, clean = scored.agg(
        F.sum(((F.col("score") >= 0.5) & (F.col("toxic") == 1)).cast("int")), F.sum("toxic"), F.sum(((F.col("score") >= 0.5) & (F.col("toxic") == 0)).cast("int")), F.sum(1 - F.col("toxic"))
    ).first()
    assert hit / toxic > 0.9 and false / clean < 0.01


def test_edges(messy, none, real, labels):
    blind = X.learn(messy, labels.where("false"))
    scores = [r["score"] for r in X.with_score(messy.drop("score"), blind).collect()]
    assert len(scores) == messy.count() and max(scores) < 0.5 and len(set(scores)) == 1
    model = X.learn(real, labels)
    out = X.with_score(messy, model, out="toxic_score")
    assert out.columns == [*messy.columns, "toxic_score"] and out.where("toxic_score between 0 and 1").count() == messy.count()
    assert X.with_score(none, model, out="toxic_score").count() == 0
    empty = [r["toxic_score"] for r in out.where("text is null or text = ''").collect()]
    assert len(set(empty)) == 1 and empty[0] < 0.5
