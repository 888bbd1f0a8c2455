"""Spanish stems: a sample of the algorithm's published vocabulary, and whole paradigms."""

from __future__ import annotations

import pytest

from millrace.functions.stemming import regions, spanish_stem, stem_table

#: Words of the published sample vocabulary and their stems.
SAMPLE = """che che checa chec checar chec checo chec checoslovaquia checoslovaqui chedraoui chedraoui chefs chefs cheliabinsk cheliabinsk
chelo chel chemical chemical chemise chemis chepo chep cheque chequ chequeo cheque cheques chequ cheraw cheraw chesca chesc
chester chest chetumal chetumal chetumaleños chetumaleñ chevrolet chevrolet cheyene cheyen cheyenne cheyenn chi chi chía chi
chiapaneca chiapanec chiapas chiap chiba chib chic chic chica chic chicago chicag chicana chican chicano chican chicas chic
chicharrones chicharron chichen chich chichimecas chichimec chicles chicl chico chic
torá tor tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer
toreros torer torio tori tormenta torment tormentas torment tornado torn tornados torn tornar torn tornen torn torneo torne torneos torne
tornillo tornill tornillos tornill torniquete torniquet torno torn toro tor toronto toront toros tor torpedearon torped torpeza torpez
torrado torr torralba torralb torre torr torrencial torrencial torrenciales torrencial torrente torrent torreon torreon torreón torreon
torres torr torrescano torrescan"""
PARADIGMS = {
    "habl": "hablo hablas habla hablamos habláis hablan hablé hablaste habló hablasteis hablaron hablaba hablabas hablábamos hablabais hablaban hablaré hablarás hablará hablaremos hablaréis hablarán hablaría hablarías hablaríamos hablaríais hablarían hable hables hablemos habléis hablen hablara hablaras habláramos hablarais hablaran hablase hablases hablásemos hablaseis hablasen hablar hablando hablado hablada hablados habladas hablarlo hablándole hablarme",
    "com": "como comes come comemos coméis comen comí comiste comió comimos comisteis comieron comía comías comíamos comíais comían comeré comerás comerá comeremos comeréis comerán comería comerías comeríamos comeríais comerían coma comas comamos comáis coman comiera comieras comiéramos comierais comieran comiese comieses comiésemos comieseis comiesen comer comiendo comido comida comidos comidas comerlo comiéndolas",
    "viv": "vivo vives vive vivimos vivís viven viví viviste vivió vivisteis vivieron vivía vivías vivíamos vivíais vivían viviré vivirás vivirá viviremos viviréis vivirán viviría vivirías viviríamos viviríais vivirían viva vivas vivamos viváis vivan viviera vivieras viviéramos vivierais vivieran viviese vivieses viviésemos vivieseis viviesen vivir viviendo vivido vivida vividos vividas",
}
#: By the rules: a suffix of each kind, in its region and outside.
RULES = """socialismo social amables amabl famosa famos nacimiento nacimient sentimientos sentimient operador oper operaciones oper comunicación comun
biología biolog tecnologías tecnolog solución solucion contribuciones contribu presencia presenci diferencia diferent preferencias preferent
rápidamente rapid nuevamente nuev activamente activ relativamente relat amablemente amabl posiblemente posibl capacidad capac
actividades activ posibilidad posibil decisivas decis contribuye contribu construyendo constru huyó huy sigue sig paguen pag averigüe averigü
haciéndola hac comprárselo compr irse irse sol sol y y él el añ añ"""


def pairs(text: str) -> list[tuple[str, str]]:
    parts = text.split()
    return list(zip(parts[::2], parts[1::2], strict=True))


KNOWN = [*pairs(SAMPLE), *((w, stem) for stem, words in PARADIGMS.items() for w in words.split())]


def test_known_stems():
    assert len(KNOWN) >= 200
    assert {w: spanish_stem(w) for w, _ in KNOWN} == dict(KNOWN)


@pytest.mark.parametrize(("word", "stem"), pairs(RULES))
def test_rules(word, stem):
    assert spanish_stem(word) == stem


def test_regions():
    assert regions("macho") == (3, 3, 5)
    assert regions("oliva") == (3, 2, 4)
    assert regions("trabajo") == (3, 4, 6)
    assert regions("áureo") == (3, 3, 5)
    assert regions("") == (0, 0, 0)


def test_stem_table_has_each_word_once(spark):
    words = spark.createDataFrame([("casas",), ("casas",), ("casa",), (None,), ("",)], "term string")
    assert sorted(map(tuple, stem_table(words).collect())) == [("", ""), ("casa", "cas"), ("casas", "cas")]
