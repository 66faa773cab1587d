import pytest

from retentia.llm import queries, surrogates as sg

SECRET = "k"


def rewritten(df, **settings):
    return sg.pseudonymised(df, "text", SECRET, **settings)


def test_formats_and_types_are_kept():
    text = ("Mail Anna.Meyer9@Mail7.example.com or +1 (017) 555-7713, 97.51.17.173, card 4845168114407329, "
            "4111-1111-1111-1111, id 473696257, 123-45-6789; Mrs. Anna Meyer met Mr Ivan Meyer and господин Иванов")
    new, spans = sg.replace(text, SECRET, {})
    found = [new[a:b] for a, b, _ in spans]
    assert [k for _, _, k in spans] == ["email", "phone", "ip", "card", "card", "number", "number", "female", "surname",
                                        "male", "surname", "surname"]
    old = [text[a:b] for a, b, _, _ in sg.entities(text)]
    assert all(o != n for o, n in zip(old, found))
    mail, phone, ip, card, luhn, *_ = found
    assert mail.endswith(".com") and mail[0].isupper() and mail[5].isupper() and mail.count(".") == 3
    assert phone.startswith("+1 (") and phone[7:9] == ") " and len(phone) == len(old[1])
    assert all(0 < int(p) < 255 for p in ip.split(".")) and card.isdigit() and len(card) == 16
    assert sg.luhn(sg._digits(luhn)) and luhn[4] == luhn[9] == "-"
    assert found[7].lower() in {n.lower() for n in sg.FEMALE} and found[9].lower() in {n.lower() for n in sg.MALE}
    assert found[8] == found[10] and found[8][0].isupper()
    assert all("а" <= c <= "я" for c in found[11].lower())


def test_coreference_across_spellings_and_documents(spark):
    df = spark.createDataFrame([(1, "a.b@c.org and 0175557713 no"), (2, "A.B@C.ORG +1 (017) 555-7713"),
                                (3, "(017) 555-7713")], "id int, text string")
    got = {r["id"]: r["text"] for r in rewritten(df).collect()}
    assert got[1].split(" ")[0] == got[2].split(" ")[0].lower()
    assert sg._digits(got[2].split(" ", 1)[1])[1:] == sg._digits(got[3])


def test_names_and_numbers_in_other_forms():
    text = ("Mr Ivan Meyer came. Meyer left, Meyers and meyer stayed. Dr Jane Smith, Prof. Dr. Anna Meyer and Mr John Michael "
            "Smith; 555-123-4567 or 555.123.4567, 2001:DB8::1f and 12:30:45, 555-123-456")
    new, spans = sg.replace(text, SECRET, {})
    old = [(text[a:b], k) for a, b, k, _ in sg.entities(text)]
    assert old == [("Ivan", "male"), ("Meyer", "surname"), ("Meyer", "surname"), ("Jane", "forename"), ("Smith", "surname"),
                   ("Anna", "female"), ("Meyer", "surname"), ("John", "male"), ("Michael", "male"), ("Smith", "surname"),
                   ("555-123-4567", "phone"), ("555.123.4567", "phone"), ("2001:DB8::1f", "ip6")]
    got = [new[a:b] for a, b, _ in spans]
    assert got[1] == got[2] == got[6] and got[4] == got[9] and got[10].replace("-", ".") == got[11]
    assert "::" in got[12] and len(got[12]) == len("2001:DB8::1f") and "12:30:45, 555-123-456" in new
    assert "Meyers and meyer stayed" in new


def test_short_formats_grow_and_stay_different(spark):
    from itertools import product

    short = ["".join(p) for p in product("abcdefghijklmnopqrstuvwxyz", repeat=2)]
    found = [("surname", w) for w in short] + [("email", f"{w}@x.org") for w in short] + [
        ("ip6", sg.ipaddress.IPv6Address(f"fe::{i:x}").exploded) for i in range(1, 40)]
    again = {(r["kind"], r["canonical"]): r["attempt"] for r in sg.settle(
        spark.createDataFrame(found, "kind string, canonical string"), SECRET).collect()}
    made = {(k, sg.surrogate(SECRET, k, c, again.get((k, c), 0))) for k, c in found}
    assert len(made) == len(found) and not made & set(found)
    assert sg.shown("email", "aB@X.org", "qzr@y.org") == "qzR@Y.org"


def test_without_a_secret_the_session_draws_one(spark, sf):
    spark.conf.unset("retentia.surrogate.secret")
    queries.QUERIES["op3_keyed_surrogates"](spark, sf)
    assert len(spark.conf.get("retentia.surrogate.secret")) == 64


def test_colliding_draws_are_made_again(spark, monkeypatch):
    plain = sg.surrogate
    few = lambda s, kind, canonical, attempt: (
        "1.1.1.1" if attempt == 0 else plain(s, kind, canonical, attempt))
    monkeypatch.setattr(sg, "surrogate", few)
    found = [("ip", f"9.9.9.{i}") for i in range(8)] + [("ip", "1.1.1.1")]
    again = sg.settle(spark.createDataFrame(found, "kind string, canonical string"), SECRET).collect()
    # the first draw is an address of the corpus, so nobody may keep it
    assert sorted(r["canonical"] for r in again) == sorted(c for _, c in found) and {r["attempt"] for r in again} == {1}


@pytest.mark.parametrize("carried", [sg.CARRIED, -1])
def test_redrawn_surrogates_reach_their_documents(spark, monkeypatch, carried):
    rows = [(i, f"call Mr {n} Smith") for i, n in enumerate(["Tom", "Tim", "Jim", "Rob", "Bob", "Max", "Ben", "Ron"] * 6)]
    rows += [(90 + i, f"Mr Q{chr(97 + i)}x Smith") for i in range(26)] + [(200, None), (201, "")]
    monkeypatch.setattr(sg, "CARRIED", carried)
    out = rewritten(spark.createDataFrame(rows, "id int, text string")).collect()
    first = {}
    for r, (i, t) in zip(sorted(out, key=lambda r: r["id"]), sorted(rows)):
        assert r["id"] == i
        if t:
            first.setdefault(t.split("Mr ")[1].split(" ")[0], set()).add(r["text"].split("Mr ")[1].split(" ")[0])
    assert all(len(s) == 1 for s in first.values())
    assert len({next(iter(s)) for s in first.values()}) == len(first) == 34
    assert [r["text"] for r in out if r["id"] >= 200] in ([None, ""], ["", None])


def test_query_leaves_no_entity_and_nothing_else_changes(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    real = {e[2:] for t in docs.values() for e in sg.entities(t)}
    stands = {}
    for r in queries.QUERIES["op3_keyed_surrogates"](spark, sf).collect():
        old, new = docs.pop(r["doc_id"]), r["text"]
        spans = [(e["start"], e["end"]) for e in r["entities"]]
        mentions = list(sg.entities(old))
        assert len(spans) == len(mentions) == r["n_entities"]
        at = was = 0
        for (a, b), (c, d, kind, canonical) in zip(spans, mentions):
            assert new[at:a] == old[was:c]
            stands.setdefault((kind, canonical), set()).add(new[a:b].lower())
            at, was = b, d
        assert new[at:] == old[was:]
        assert not real & {e[2:] for e in sg.entities(new)}
    assert not docs and real
    assert len({(k, s) for (k, _), own in stands.items() for s in own}) >= len(stands)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x 97.51.17.173", "a", "b")], "entities int, text string, replaced string, redrawn string")
    out = rewritten(df)
    assert out.columns == ["text", "replaced", "redrawn", "entities"] and out.head()["replaced"] == "a"
    assert rewritten(df.limit(0)).collect() == []
