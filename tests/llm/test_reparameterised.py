"""Questions that come back with other numbers, names and units, in four languages, made apart from the operator's own rules."""

import random

from flowjobs.llm import decontam

#: templates of questions: n a number, w a number that may be written out, u a length, t a time, p and q names
QUESTIONS = [
    "A train leaves the station at noon and runs {n} {u} in {w} {t} before it stops. How far does it get in {n2} {t} at the same speed?",
    "Yesterday {p} bought {w} baskets of apples at the market and gave {n} of them to {q}. How many apples are left if each basket holds {n2} apples?",
    "The tank loses {n} liters every {t1} through a small crack in its wall. After how many {t} is it empty if it held {n2} liters at first?",
    "Ein Läufer braucht für {n} {u} genau {w} {t} und macht dann eine Pause. Wie lange braucht er ohne Pause für {n2} {u}, wenn er gleich schnell bleibt?",
    "Gestern hat {p} auf dem Weg zur Arbeit {n} {u} zurückgelegt und dabei {w} mal angehalten. Wie oft hält er bei {n2} {u} an, wenn es so weiter geht?",
    "Un cycliste parcourt {n} {u} en {w} {t} puis il se repose un peu. Combien de temps lui faut-il pour parcourir {n2} {u} sans se reposer?",
    "Hier soir {p} a donné {n} billes à {q} avant de rentrer chez lui avec {n2} billes dans son sac. Combien de billes avait-il au début de la soirée?",
    "Un camión recorre {n} {u} en {w} {t} y después se detiene a cargar. ¿Cuánto tarda en recorrer {n2} {u} si no se detiene en el camino?",
    "Ayer {p} compró {n} naranjas en la tienda de la esquina y regaló {n2} a {q}. ¿Cuántas naranjas le quedan para hacer el zumo de hoy?",
]
WORDS = {"en": "two three four five six seven eight nine ten twelve".split(), "de": "zwei drei vier fünf sechs sieben acht neun zehn zwölf".split(), "fr": "deux trois quatre cinq sept huit neuf dix douze".split(), "es": "dos tres cuatro cinco seis siete ocho nueve diez doce".split()}
LENGTHS = {"en": "kilometers miles meters yards".split(), "de": "Kilometer Meilen Meter".split(), "fr": "kilomètres mètres".split(), "es": "kilómetros millas metros".split()}
TIMES = {"en": "hours minutes days".split(), "de": "Stunden Minuten Tage".split(), "fr": "heures minutes jours".split(), "es": "horas minutos días".split()}
PEOPLE = "Anna Peter Maria Jonas Clara Felix Irene Marco Nadia Oscar".split()
LANGUAGE = ["en"] * 3 + ["de"] * 2 + ["fr"] * 2 + ["es"] * 2


def ask(rnd, k):
    lang = LANGUAGE[k]
    p, q = rnd.sample(PEOPLE, 2)
    w = rnd.choice([rnd.choice(WORDS[lang]), str(rnd.randrange(2, 30))])
    times = rnd.choice(TIMES[lang])
    numbers = rnd.sample(range(31, 999), 2)
    return QUESTIONS[k].format(n=numbers[0], n2=numbers[1], w=w, u=rnd.choice(LENGTHS[lang]), t=times, t1=times.rstrip("s"), p=p, q=q)


def clean(rnd):
    words = "the of and house river morning people walked slowly under trees while children played near water because nobody wanted to leave before evening came Haus Weg Stadt der die und sehr maison rivière dans les casa calle para todos".split()
    return ". ".join(" ".join(rnd.choice([*words, rnd.choice(PEOPLE), str(rnd.randrange(100)), rnd.choice(TIMES["en"])]) for _ in range(rnd.randrange(6, 25))).capitalize() for _ in range(6))


def found(spark, docs, items):
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(a, b).collect()}


def test_recall_and_false_reports(spark):
    rnd = random.Random(11)
    items = [(k, ask(rnd, k)) for k in range(len(QUESTIONS))]
    docs = [(i, f"{clean(rnd)}. {ask(rnd, i % len(QUESTIONS))} {clean(rnd)}.") for i in range(200)]
    fair = [(1000 + i, clean(rnd)) for i in range(1000)]
    got = found(spark, docs + fair, items)
    hit = {(i, i % len(QUESTIONS)) for i in range(200)} & got
    assert len(hit) >= 180, sorted({(i % len(QUESTIONS)) for i in range(200)} - {k for _, k in hit})
    assert not {d for d, _ in got if d >= 1000}


def test_probes(spark):
    items = [
        (1, "A train runs 120 kilometers in 2 hours on a straight track. How many kilometers does it run in 5 hours at the same speed?"),
        (2, "Wie viel Zeit braucht der Zug für die Strecke, wenn das Tempo um ein Viertel sinkt und die Pause entfällt?"),
        (3, "On Monday morning Anna gave a red pencil and a blue pencil to Bob before the lesson, and later on Bob gave a pencil back to Anna."),
    ]
    docs = [
        (1, "A train runs 90 miles in 3 hours on a straight track. How many miles does it run in 7 hours at the same speed?"),
        (2, "Wie viel Geld braucht der Bus für die Reise, wenn der Preis um ein Drittel sinkt und die Steuer entfällt?"),
        (3, "On Monday morning Clara gave a red pencil and a blue pencil to Felix before the lesson, and later on Felix gave a pencil back to Clara."),
        (4, "On Monday morning Clara gave a red pencil and a blue pencil to Clara before the lesson, and later on Clara gave a pencil back to Clara."),
        (5, items[1][1]),
        (6, "A train runs ninety miles in three hours on a straight track. How many miles does it run in seven hours at the same speed?"),
    ]
    assert found(spark, docs, items) == {(1, 1), (3, 3), (5, 2), (6, 1)}
