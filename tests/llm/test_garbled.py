"""Garbled texts restored, on texts of our own with held-out garbling."""

import random

import pytest

from quarrycast.llm import garbled
from tests.conftest import rows

CLEAN = {
    "en": ["The café in Zürich – “a naïve plan” – costs €5, it’s said.", "We hire in München and Málaga; the résumé isn’t needed.", "A plain sentence about boats and trains… and more."],
    "fr": ["L'équipe préfère un déjeuner léger près de l'hôtel où ça coûte peu.", "Très bientôt, l'été sera là, à côté des élèves."],
    "de": ["Größere Änderungen übernimmt die Gruppe für spätere Züge.", "Die Bäcker grüßen höflich über die Straße."],
    "pl": ["Wysokość płacy podajemy już w ogłoszeniu, także w mieście.", "Zgłoszenia czyta zespół; odpowiedź wyślemy w ciągu tygodnia."],
    "ru": ["Резюме можно прислать в любое время, мы ответим быстро.", "Компания из города привлекла новый раунд и ищет людей."],
    "zh": ["我们在上海招聘熟悉数据库的工程师，支持远程办公。", "公司完成了新一轮融资，计划新增岗位。"],
    "ja": ["会社は新しい資金を調達しました。面接は一週間以内です。", "在宅勤務も可能です。技術者を募集します。"],
}
CHAINS = [("en", "utf-8", "cp1252"), ("en", "utf-8", "latin-1"), ("fr", "utf-8", "cp1252"), ("de", "utf-8", "mac_roman"), ("de", "utf-8", "cp437"), ("fr", "utf-8", "cp1251"), ("pl", "cp1250", "cp1252"), ("ru", "cp1251", "latin-1"), ("ru", "koi8_r", "cp1251"), ("zh", "gb18030", "latin-1"), ("ja", "cp932", "latin-1"), ("zh", "utf-8", "latin-1"), ("ja", "utf-8", "latin-1")]


@pytest.fixture(scope="module")
def model():
    return garbled.Model({k: v * 3 for k, v in CLEAN.items()})


@pytest.mark.parametrize("lang,real,taken", CHAINS)
def test_chains(model, lang, real, taken):
    for t in CLEAN[lang]:
        try:
            bad = t.encode(real).decode(taken)
        except UnicodeDecodeError:
            continue
        assert model.restore(bad) == t
        assert model.restore(f"{CLEAN['en'][2]}\n{bad}") == f"{CLEAN['en'][2]}\n{t}"


def test_twice_and_in_part(model):
    for t in CLEAN["fr"] + CLEAN["de"]:
        once = t.encode().decode("latin-1")
        assert model.restore(once.encode().decode("latin-1")) == t
    rng = random.Random(1)
    for t in CLEAN["en"] + CLEAN["de"]:
        part = "".join(c.encode().decode("latin-1") if c > "\x7f" and rng.random() < 0.5 else c for c in t)
        assert model.restore(part) == t


def test_clean_texts_stay(model):
    for texts in CLEAN.values():
        for t in texts:
            assert model.restore(t) == t
    for t in ["", "plain", "\xa0", " 　\n", "Ⅻ ½ ™ ©", "🚀 now", "SÃO PAULO E NÃO", "1 — 2 … 3 £5"]:
        assert model.restore(t) == t


def test_operator(spark):
    data = [(i, t, k, "x") for i, (k, t) in enumerate((k, t) for k, ts in CLEAN.items() for t in ts * 3)]
    bad = CLEAN["fr"][0].encode().decode("latin-1")
    data += [(100, bad, "fr", ""), (100, bad, "fr", ""), (101, "na��ve", "en", ""), (102, None, None, None), (103, "", "en", ""), (104, "\xa0", "en", ""), (None, bad, "FR-XX", ""), (105, "ж" * 30_000, "ru", "")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, lost string")
    got = rows(garbled.restore(df).where("doc_id >= 100 or doc_id is null"))
    good = CLEAN["fr"][0]
    assert got == [(100, good, False), (100, good, False), (101, None, True), (None, good, False)]
    assert garbled.restore(df).where("doc_id < 100").count() == 0
    assert garbled.restore(df.where("false")).count() == 0


RUSSIAN = ["Компания из города {} привлекла новый раунд и откроет {} вакансий.", "Мы ищем инженера в команду {}, который знает {} языков.", "Собеседование в городе {} длится {} минут, затем мы отвечаем."]


def test_garbled_texts_in_the_sample(spark):
    """Several KOI8-R texts read as cp1251, which the cleanliness pattern takes for clean, all in the sample."""
    towns = ["Казань", "Москва", "Томск", "Пермь", "Омск", "Тверь", "Самара", "Орёл"]
    data = [(i, RUSSIAN[i % 3].format(towns[i % 8], i), "ru") for i in range(48)]
    good = {100 + i: RUSSIAN[i % 3].format(towns[i % 8], 50 + i) for i in range(5)}
    data += [(k, t.encode("koi8_r").decode("cp1251"), "ru") for k, t in good.items()]
    data += [(200, RUSSIAN[0].format("Омск", 7) + "\n" + RUSSIAN[1].format("voice", 3).encode("koi8_r").decode("cp1251"), "ru")]
    good[200] = RUSSIAN[0].format("Омск", 7) + "\n" + RUSSIAN[1].format("voice", 3)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert rows(garbled.restore(df)) == sorted((k, t, False) for k, t in good.items())
    assert len(garbled.sample(df, "text", "lang")["ru"]) == 48


def test_pairs_that_clean_texts_of_another_language_have():
    """cp1250 read as cp1252, all of whose pairs of characters occur in French."""
    texts = ["Komisja będzie tu, komitet będzie tam, a dyrektor będzie wszędzie.", "Zespół będzie czekał."]
    odd = ["La bête bêlait, le bêta bêdait; on fêtait, zêdait.", "Un bêdeau zêdait et bêlait près de la bête."]
    m = garbled.Model({"pl": texts * 3, "fr": odd * 3})
    for t in texts[:1]:
        assert m.restore(t.encode("cp1250").decode("cp1252")) == t


@pytest.mark.parametrize("real,taken,times", [("utf-8", "latin-1", 1), ("utf-8", "latin-1", 2), ("gb18030", "latin-1", 1)])
def test_long_runs_are_not_cut_inside_a_character(model, real, taken, times):
    for lead in ("x", "xy", "xyz"):
        t = bad = lead + "我们在上海招聘熟悉数据库的工程师支持远程办公" * 180
        for _ in range(times):
            bad = bad.encode(real).decode(taken)
        assert len(bad) > garbled.LONGEST and model.restore(bad) == t


def test_the_counts_are_those_of_all_texts(spark):
    """Long texts, many texts of a language and many languages all count, none of them a sample."""
    import string

    codes = [a + b for a in string.ascii_lowercase for b in string.ascii_lowercase][:230]
    data = [(f"Ein Satz über Nummer {i}, größer als alle.", "de") for i in range(1500)] + [("Ein Satz über Nummer 5, größer als alle. " * 200, "de")] + [(f"{c} né à Paris", c + "x") for c in codes]
    held = garbled.fit(spark.createDataFrame(data, "text string, lang string"), "text", "lang")
    assert len(held["de"]) == 1501 and sum(map(len, held.values())) == len(data) and len(held) == 231
    for code, counts in held.items():
        want = garbled.Counts.of([t for t, k in data if k == code])
        assert (counts.codes == want.codes).all() and (counts.n == want.n).all()
