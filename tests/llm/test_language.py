import pytest
from pyspark.sql import functions as F

from silvaframe.llm import language as L

SENTENCES = {
    "es": "La madera tiene un color claro y los vasos están en grupos|No queda claro si las fibras deben marcarse por separado|El lote llegó la semana pasada con muchas muestras|Conviene revisar esta pieza antes de cerrar la ficha|Hasta ahora nadie había descrito los canales de esta especie",
    "en": "The wood has a light colour and the vessels are in groups|It is not clear whether the fibres should be marked one by one|The batch arrived last week with many of the samples|Please check this piece before you close the sheet|Until now nobody had described the canals of this species",
    "pt": "A madeira tem uma cor clara e os vasos estão em grupos|Não está claro se as fibras devem ser marcadas em separado|O lote chegou na semana passada com muitas amostras|Convém rever esta peça antes de fechar a ficha|Até agora ninguém tinha descrito os canais desta espécie",
    "fr": "Le bois a une couleur claire et les vaisseaux sont en groupes|On ne sait pas encore s'il faut marquer les fibres une par une|Le lot est arrivé la semaine dernière avec beaucoup de pièces|Il faut revoir cette pièce avant de fermer la fiche|Jusqu'ici personne n'avait décrit les canaux de cette espèce",
    "de": "Das Holz hat eine helle Farbe und die Gefäße liegen in Gruppen|Es ist noch nicht klar, ob die Fasern einzeln markiert werden|Das Los kam in der letzten Woche mit vielen Proben an|Bitte prüfen Sie dieses Stück, bevor Sie das Blatt schließen|Bisher hatte niemand die Kanäle dieser Art beschrieben",
    "it": "Il legno ha un colore chiaro e i vasi sono in gruppi|Non è ancora chiaro se le fibre si debbano segnare una per una|Il lotto è arrivato la settimana scorsa con molti campioni|Conviene rivedere questo pezzo prima di chiudere la scheda|Finora nessuno aveva descritto i canali di questa specie",
}
PARTS = {k: v.split("|") for k, v in SENTENCES.items()}
TABLE = "0273-7.jpg | 93 | 88 | 0.0313\n0273-7.jpg | RAD | 40 | 0.0207"


@pytest.fixture(scope="module")
def model():
    docs = []
    for k, p in PARTS.items():
        for i in range(12):
            a, b, c = p[i % 5], p[(i + 1 + i // 5) % 5], p[(i + 3) % 5]
            docs.append((f"{a}. {b}.\n\n{c}.", k if i else "en"))  # one wrong label in twelve
    return L.train(docs)


def run(spark, model, rows):
    t = spark.createDataFrame([(i, x, None) for i, x in enumerate(rows)], "doc_id long, text string, label string")
    return {(r["doc_id"], r["segment_no"]): r for r in L.labelled(t, model).collect()}


def test_held_out_accuracy(model):
    texts = {"es": "Los anillos se ven cerca del borde y las muestras son claras", "en": "The rings are near the edge and the samples are clear", "pt": "Os anéis estão perto da borda e as amostras não são claras", "fr": "Les pièces sont près du bord et les groupes ne sont pas clairs", "de": "Die Proben liegen nicht am Rand und das Stück ist noch hell", "it": "Gli anelli sono vicino al bordo e i campioni non sono chiari"}
    for k, t in texts.items():
        for form in (t, t.upper(), t.lower(), f"<p>{t}</p>", t.encode().decode("cp1252", "ignore")):
            p = model.scores([x for x, _ in L.pieces(form)])
            assert L.LANGUAGES[p.mean(0).argmax()] == k, (k, form)


def test_documents_and_paragraphs(spark, model):
    es, de, it = (". ".join(PARTS[k]) + "." for k in ("es", "de", "it"))
    mixed = f"{es}\r\n \t\r\n{TABLE}\r\n\r\n{PARTS['de'][0]}. {PARTS['de'][1]}.\r{PARTS['es'][0]}."
    got = run(spark, model, [mixed, TABLE, None, "", " \n ", it * 400, f"{de}\n\n{TABLE}", "Goribella fluvialis", "¿?"])
    code = {k: r["lang_code"] for k, r in got.items()}
    assert [code[0, i] for i in range(4)] == ["es", "es", "und", "de"] and (0, 4) not in code and got[0, 0]["mixed"]
    assert [code[i, 0] for i in range(1, 9)] == ["und", "und", "und", "und", "it", "de", "und", "und"]
    assert not got[6, 0]["mixed"] and code[6, 2] == "und" and (2, 1) not in code
    assert 0.5 < got[5, 0]["confidence"] <= 1 and got[1, 0]["confidence"] == 0


def test_labels(spark):
    rows = ["es", "ES-mx", "pt_BR", "Español", "castellano", "English", "deu", "français", "nl", "und", "xx", "", None, "N/A", "-", " it "]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, l string").select("i", L.label_language(F.col("l")).alias("x"))
    assert [r["x"] for r in t.orderBy("i").collect()] == ["es", "es", "pt", "es", "es", "en", "de", "fr", "other", None, None, None, None, None, None, "it"]


def test_nothing_to_learn_from(spark):
    t = spark.createDataFrame([(1, "Una frase sin etiqueta.", None)], "doc_id long, text string, label string")
    assert L.sample(t) == [] and L.train([]) is None and L.train([(None, "es"), ("", "en")]) is None
    assert [r["lang_code"] for r in L.labelled(t, None).collect()] == ["und", "und"]
    assert L.labelled(t.where("false"), None).count() == 0


def test_paragraph_rules():
    assert L.paragraphs("a\nb\n\n \n\r\nc\r\rd") == ["a b", "c", "d"]
    assert L.paragraphs("") == [] and L.paragraphs(TABLE) == [" "]
    assert L.mended("SÃ£o &amp; <b>x</b>") == "São &  x "
    assert sum(c for _, c in L.pieces("Una frase bastante normal. Otra frase más corta.")) == pytest.approx(47, abs=2)


def test_sample_is_bounded(spark):
    t = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("texto de prueba").alias("text"), F.lit("es").alias("label"))
    assert 50 < len(L.sample(t, 100)) < 200


def test_calibration_sees_through_wrong_labels():
    import numpy as np

    rng = np.random.default_rng(3)
    z = rng.normal(0, 2, (6000, 6))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    true = (p.cumsum(1) > rng.random((len(z), 1))).argmax(1)
    said = np.where(rng.random(len(z)) < 0.15, (true + rng.integers(1, 6, len(z))) % 6, true)
    t, noise, error = L.calibrated(z * 3, said)
    assert 2.6 < t < 3.4 and 0.11 < noise < 0.19 and error < 0.02


def test_sample_is_bounded(spark):
    rows = [(i, "palabra " * (5000 if i == 7 else 5), "es") for i in range(300)]
    t = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = L.sample(t, per_language=20)
    assert 5 < len(got) <= 240 and max(len(x) for x, _ in got) <= L.LONGEST


def test_markup_of_any_length_is_no_prose():
    assert L.mended("<a " + "x" * 5000 + ">hola</a>").strip() == "hola" and "3 < 4 > 2" in L.mended("3 < 4 > 2")
