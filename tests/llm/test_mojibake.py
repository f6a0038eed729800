import pytest

from folioscope.llm import mojibake as mj

CLEAN = [
    "La evaluación del código compara el tamaño de los módulos según los datos públicos",
    "L'évaluation proposée accélère la détection précoce et la méthode légère précède les décisions d'équipe",
    "Die Prüfung großer Entwürfe unterstützt häufig die Änderung von Anforderungen für größere Vorhaben",
    "A medição contínua não reduz as decisões de integração e a gestão de versões mostrou a manutenção",
    "Response time fell by 43 µs (±5 %); the team’s naïve baseline was “good enough” – not a cure, i.e. α × 34 ≥ 8",
    "José Núñez; Søren Åberg; Zoltán Kovács; Hélène Brontë; Jürgen Müller; Paweł Łukasz; Kateřina Dvořák",
]
WAYS = ["cp1252", "mac_roman", "cp437", "cp1251", "cp1250"]


def spoil(text: str, wrong: str) -> str:
    table = {b: c for c, b in mj._byte_of(wrong).items()}
    return "".join(table.get(b, chr(b)) if b > 127 else chr(b) for b in text.encode())


@pytest.fixture(scope="module")
def table(make_papers):
    rows = [{"paper_id": 10_000 + i, "title": CLEAN[i % 5], "abstract": CLEAN[(i + 1) % 5], "authors": CLEAN[5]} for i in range(60)]
    for k, w in enumerate(WAYS):
        for i, text in enumerate(CLEAN):
            rows.append({"paper_id": 100 * k + i, "title": spoil(text, w)})
    rows.append({"paper_id": 900, "title": spoil(spoil(CLEAN[0], "cp1252"), "cp1252")})
    rows.append({"paper_id": 901, "title": "Zolt�n and the r�sum�"})
    rows.append({"paper_id": 902, "abstract": (CLEAN[4] + ". ") * 3000})
    rows += [{"paper_id": 903}, {"paper_id": 904, "title": "", "abstract": "None"}, {"paper_id": 905, "title": "Plain words only"}]
    return make_papers(*rows, *rows[:2], extra={})


@pytest.fixture(scope="module")
def judge(spark, sf):
    p = spark.read.parquet(f"{sf}/papers.parquet")
    return mj.Judge(mj.word_counts(mj.fields_of(p, ["title", "abstract", "authors"]).select("text"), spark.read.parquet(f"{sf}/persons.parquet").select("name")))


@pytest.fixture(scope="module")
def got(table):
    return {(r.paper_id, r.src_field): r for r in mj.garbled(table).collect()}


def test_every_chain_is_found_and_undone(got):
    for k in range(len(WAYS)):
        for i, text in enumerate(CLEAN):
            assert got[100 * k + i, "title"].restored == text
    assert got[900, "title"].restored == CLEAN[0]


def test_nothing_else(got):
    assert {k for k in got if k[0] >= 901} == {(901, "title")}
    assert got[901, "title"].restored is None and got[901, "title"].lost


def _alphabets():
    def letters(a, b):
        return [chr(i) for i in range(a, b)]

    han = [bytes([a, b]).decode("gb2312") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFA) if (a, b) < (0xD7, 0xFA)]
    return {
        "Chinese": (han, 2, 14),
        "Japanese": (han[:800] + letters(0x3042, 0x3094) * 20 + letters(0x30A2, 0x30F4) * 8, 2, 14),
        "Korean": (letters(0xAC00, 0xD7A3), 2, 5),
        "Russian": ([*letters(0x430, 0x450), "ё", "А", "Р"], 1, 10),
        "Greek": ([*letters(0x3B1, 0x3CA), *"άέήίόύώ"], 1, 9),
        "Arabic": (letters(0x627, 0x64B), 2, 8),
    }


@pytest.mark.parametrize("name", list(_alphabets()))
@pytest.mark.parametrize("words", [1, 6, 120])
def test_sound_text_of_other_scripts_stays(judge, name, words):
    """None of 500 strings of a script is changed, be it a word, a title or as long as an abstract."""
    import random

    alphabet, lo, hi = _alphabets()[name]
    rng = random.Random(words)
    for _ in range(500 if words < 100 else 60):
        text = " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi))) for _ in range(words))
        assert judge.restore(text) is None, text


@pytest.mark.parametrize(
    "text",
    [
        "数据库系统的查询优化", "基于Web的服务组合", "Анализ программного обеспечения", "так там тем рад", "Гёте-Institut und die Prüfung", "ソフトウェア工学の研究", "Ανάλυση λογισμικού",
        "Phân tích yêu cầu phần mềm và kiểm thử tự động", "Metody weryfikacji oprogramowania są skuteczne", "Yazılım mühendisliğinde değişim yönetimi", "تحليل البرمجيات", "소프트웨어 공학",
    ],
)
def test_sound_titles_stay(judge, text):
    assert judge.restore(text) is None


@pytest.mark.parametrize("wrong", ["cp1251", "cp1252", "cp866", "koi8_r"])
def test_other_scripts_are_restored_too(judge, wrong):
    """Russian that was read as Latin or as another Cyrillic code comes back, though the corpus has none."""
    text = "Системы управления требованиями"
    assert judge.restore(spoil(text, wrong))[0] == text


@pytest.mark.parametrize("wrong", [*WAYS, "gbk"])
def test_round_trip(judge, wrong):
    for text in CLEAN[:4]:
        bad = text.encode().decode("gbk", "replace") if wrong == "gbk" else spoil(text, wrong)
        if "\ufffd" not in bad:
            assert judge.restore(bad)[0] == text


def test_empty(table):
    assert mj.garbled(table.limit(0)).count() == 0


def test_fields_stay_as_they_are(spark, sf):
    """Whatever is restored reads back to the original by the same chain."""
    p = spark.read.parquet(f"{sf}/papers.parquet")
    for r in mj.garbled(p).collect():
        assert r.restored is None or (r.restored != r.original and r.bits_after < r.bits_before + 8 and r.decided_by in ("zstd", "letters"))
