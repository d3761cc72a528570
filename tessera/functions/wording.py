"""Answers in the user's language, built from the verdict; and which texts of a model contradict it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators import verdict

# Wording by language; {n}, {topic} and {options} are filled in. Other languages take English.
PHRASES = {
    "es": {"yes": "Sí — la evidencia lo confirma", "no": "No — la evidencia lo refuta", "states": "señala que", "says": "dice", "confidence": "confianza", "both": "Hay evidencia seria en ambos sentidos: ", "but": "; pero ", "source": "Fuente", "also": "También lo cubren",
           "few": "No hay evidencia suficiente para confirmarlo ni refutarlo ({n} pasaje(s) evaluados; conviene reformular o esperar mejores fuentes).", "none": "No encontré evidencia para responder esta pregunta; conviene reformularla o intentar más tarde.",
           "which": "Encontré temas distintos para «{topic}»: {options}. ¿A cuál te refieres? Respóndeme y afino la búsqueda."},
    "en": {"yes": "Yes — the evidence confirms it", "no": "No — the evidence refutes it", "states": "states that", "says": "says", "confidence": "confidence", "both": "There is serious evidence both ways: ", "but": "; but ", "source": "Source", "also": "Also covered by",
           "few": "There is not enough evidence to confirm or refute it ({n} passage(s) reviewed; consider rephrasing or trying later).", "none": "I found no evidence to answer this question; try rephrasing it or asking again later.",
           "which": "I found different topics for «{topic}»: {options}. Which one do you mean? Reply and I'll refine the search."},
    "fr": {"yes": "Oui — les preuves le confirment", "no": "Non — les preuves le réfutent", "states": "indique que", "says": "dit", "confidence": "confiance", "both": "Il existe des preuves sérieuses dans les deux sens : ", "but": " ; mais ", "source": "Source", "also": "Également couvert par",
           "few": "Il n'y a pas assez de preuves pour le confirmer ou le réfuter ({n} passage(s) évalués ; reformulez ou réessayez plus tard).", "none": "Je n'ai trouvé aucune preuve pour répondre à cette question ; reformulez-la ou réessayez plus tard.",
           "which": "J'ai trouvé des sujets différents pour «{topic}» : {options}. Lequel voulez-vous dire ? Répondez et j'affine la recherche."},
    "de": {"yes": "Ja — die Belege bestätigen es", "no": "Nein — die Belege widerlegen es", "states": "schreibt:", "says": "sagt:", "confidence": "Konfidenz", "both": "Es gibt ernstzunehmende Belege in beide Richtungen: ", "but": "; aber ", "source": "Quelle", "also": "Ebenfalls behandelt von",
           "few": "Es gibt nicht genug Belege, um es zu bestätigen oder zu widerlegen ({n} Passagen geprüft; formuliere um oder versuche es später erneut).", "none": "Ich habe keine Belege gefunden, um diese Frage zu beantworten; formuliere sie um oder versuche es später.",
           "which": "Ich habe verschiedene Themen zu «{topic}» gefunden: {options}. Welches meinst du? Antworte und ich verfeinere die Suche."},
    "pt": {"yes": "Sim — as evidências confirmam", "no": "Não — as evidências refutam", "states": "indica que", "says": "diz", "confidence": "confiança", "both": "Há evidências sérias em ambos os sentidos: ", "but": "; mas ", "source": "Fonte", "also": "Também cobrem o tema",
           "few": "Não há evidência suficiente para confirmar ou refutar ({n} passagem(ns) avaliadas; reformule ou tente mais tarde).", "none": "Não encontrei evidências para responder a esta pergunta; reformule-a ou tente mais tarde.",
           "which": "Encontrei temas diferentes para «{topic}»: {options}. A qual você se refere? Responda e eu refino a busca."},
    "it": {"yes": "Sì — le prove lo confermano", "no": "No — le prove lo confutano", "states": "indica che", "says": "dice", "confidence": "fiducia", "both": "Ci sono prove serie in entrambi i sensi: ", "but": "; ma ", "source": "Fonte", "also": "Ne parlano anche",
           "few": "Non ci sono prove sufficienti per confermarlo o confutarlo ({n} passaggi valutati; riformula o riprova più tardi).", "none": "Non ho trovato prove per rispondere a questa domanda; riformulala o riprova più tardi.",
           "which": "Ho trovato argomenti diversi per «{topic}»: {options}. Quale intendi? Rispondi e affino la ricerca."},
}
# Words that tell the opposite of a verdict.
OPPOSITE = {
    verdict.SUPPORTED: ("refutada", "refutado", "es falsa", "es falso", "refuted", "is false"),
    verdict.REFUTED: ("sustentada", "sustentado", "es cierta", "es cierto", "es verdadera", "supported", "is true"),
}
THOUGHT = r"(?s)<think>.*?(</think>|\z)"


def phrase(lang: Column, name: str, **filled: Column) -> Column:
    """A phrase in a language, its {marks} replaced."""
    out = F.lit(PHRASES["en"][name])
    for code, phrases in PHRASES.items():
        out = F.when(lang == code, phrases[name]).otherwise(out)
    for mark, value in filled.items():
        out = F.replace(out, F.lit(f"{{{mark}}}"), value)
    return out


def percent(share: Column) -> Column:
    """A share in whole percent, halves to even."""
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))


def concise(lang: Column, told: Column, confidence: Column, voices: Column, pro: Column, con: Column) -> Column:
    """The answer of one breath. pro and con: the strongest voice of the deciding fact on either side (domain, text, url), or null."""
    sure = F.concat(phrase(lang, "confidence"), F.lit(" "), percent(confidence))
    quote = lambda v, size: F.concat(F.lit("«"), F.trim(F.substring(v["text"], 1, size)), F.lit("…»"))
    says = lambda v: F.concat(v["domain"], F.lit(" "), phrase(lang, "says"), F.lit(" "), quote(v, 110))
    both = F.concat(phrase(lang, "both"), F.concat_ws("", says(pro), F.when(pro.isNotNull() & con.isNotNull(), phrase(lang, "but")), says(con)), F.lit(" ("), sure, F.lit(")."))

    def one(base: str, v: Column) -> Column:
        whole = F.concat(phrase(lang, base), F.lit(": "), v["domain"], F.lit(" "), phrase(lang, "states"), F.lit(" "), quote(v, 150), F.lit(" ("), sure, F.lit("; "), v["url"], F.lit(")"))
        return F.when(v.isNotNull(), whole).otherwise(F.concat(phrase(lang, base), F.lit(" ("), sure, F.lit(").")))

    return (
        F.when(told == verdict.REFUTED, one("no", con))
        .when(told == verdict.SUPPORTED, one("yes", pro))
        .when(told == verdict.CONFLICTING, both)
        .otherwise(phrase(lang, "few", n=voices.cast("string")))
    )


def safe(reply: Column, told: Column) -> Column:
    """A model's text without its thoughts; null if nothing is left or it has a word of the opposite verdict."""
    clean = F.trim(F.regexp_replace(reply, THOUGHT, ""))
    against = F.lit(False)
    for name, marks in OPPOSITE.items():
        against = F.when(told == name, F.exists(F.lit(list(marks)), lambda m: F.contains(F.lower(clean), m))).otherwise(against)
    return F.when((clean != "") & ~against, clean)
