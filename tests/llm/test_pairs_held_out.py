"""Refusals and languages on texts that were written apart from the tables."""

from heronlake.llm import pairs as P

REFUSALS = [
    "My guidelines keep me from responding to questions of this kind.",
    "I would rather not comment on that. A pharmacist can help.",
    "That lies beyond what this assistant may discuss.",
    "I'm unable to provide medical advice.",
    "I cannot help you with this. Please contact a clinic.",
    "Sorry, but I won't be able to answer that.",
    "Unfortunately, I am not in a position to give you guidance on this topic.",
    "I'm afraid I can't say. You should speak to your physician.",
    "We are not permitted to discuss individual cases. Please get in touch with your surgery.",
    "As a language model, I can't offer a diagnosis.",
    "The passages provided do not contain an answer to this question.",
    "There is no information in the context that would let me answer the question; the documents do not mention it.",
    "I don't have enough information to respond.",
    "I have to decline this request.",
    "I refuse to answer questions about that.",
    "Your question falls outside my area, so I can't respond to it. I hope you understand.",
    "It would not be appropriate for me to advise you on this. Please see a nurse.",
    "I do not know the answer to that.",
    "I am not qualified to give an opinion on your case. Your doctor can advise you.",
    "Our rules forbid us to answer requests like this one. Thank you for your understanding.",
    "I'm sorry. I can't assist with that. Please ask someone at the clinic. I hope you understand. This is a sensitive topic. I am not allowed to discuss it. Please consult a specialist. Thank you.",
    "Ich darf dazu leider keine Auskunft geben.",
    "Tut mir leid, ich kann diese Frage nicht beantworten. Bitte wenden Sie sich an Ihren Arzt.",
    "Je ne suis pas autorisé à répondre à ce genre de question.",
    "Désolé, je ne peux pas vous donner de conseil. Veuillez consulter un médecin.",
    "No estoy autorizado a responder preguntas sobre este tema.",
    "Lo siento, no podemos ayudarle con eso. Consulte a su médico.",
    "Я не вправе отвечать на такие вопросы. Обратитесь к врачу.",
    "很抱歉，我不能回答这类问题。",
    "その質問にはお答えできません。医師に相談してください。",
]
ANSWERS = [
    "We would not advise stopping the tablets.",
    "I don't know, but it is rarely serious.",
    "The tablets cannot be given to children.",
    "Doctors cannot always tell which drug helps.",
    "We could not find a difference between the groups.",
    "No, it does not.",
    "You should ask your doctor before travelling.",
    "Unfortunately, relapses are common in the first year.",
    "I'm sorry you feel unwell. Drink plenty of water and rest.",
    "Please see a nurse if the wound swells. Otherwise change the dressing daily.",
    "This question is asked often. The usual dose is 5 mg at night.",
    "Patients who cannot speak should carry a card with their drugs.",
    "It is not known why the rash appears.",
    "I cannot overstate how much exercise helps.",
    "No response was seen in nine of ten patients.",
    "My advice is to wait two weeks and not to scratch.",
    "Nobody should refuse help when chest pain lasts.",
    "We do not give it with milk.",
    "I can help: take it with food.",
    "The leaflet does not say how long; most people take it for a month.",
    "Nehmen Sie das Mittel nicht mit Alkohol ein.",
    "Das kann man nicht sicher sagen, meist hilft Ruhe.",
    "Il ne faut pas arrêter le traitement sans avis.",
    "No tome este medicamento con leche.",
    "Не принимайте это средство натощак.",
    "不能与酒同服。",
    "食後に飲んでください。",
    "I have no information on children, but adults take one tablet a day.",
    "I can't recommend this drug highly enough.",
    "Many people decline the test and do well.",
]
Q = {
    "en": "What helps against a migraine at night?", "de": "Was hilft gegen Migräne in der Nacht?", "fr": "Que faire contre la migraine pendant la nuit ?", "es": "¿Qué puedo tomar para la migraña por la noche?",
}
TEXTS = [
    ("en", "A dark room and a cool cloth are what most people find useful before they take a tablet."), ("en", "Fluids, rest and a triptan."), ("en", "Sleep at the same hours each day and keep a diary of the attacks."),
    ("de", "Ein dunkles Zimmer und ein kühles Tuch helfen den meisten, bevor sie eine Tablette nehmen."), ("de", "Viele schlafen nach der Einnahme ein und wachen ohne Schmerzen auf."),
    ("fr", "Une chambre sombre et un linge frais suffisent souvent avant de prendre un comprimé."), ("fr", "Dormez à des heures régulières et notez les crises dans un carnet."),
    ("es", "Una habitación oscura y un paño frío ayudan a la mayoría antes de tomar una pastilla."), ("es", "Duerma siempre a la misma hora y anote las crisis en un cuaderno."),
    ("nl", "Een donkere kamer en een koele doek helpen de meeste mensen voor ze een tablet nemen."), ("nl", "Slaap op vaste tijden en houd een dagboek bij van de aanvallen."),
    ("pl", "Ciemny pokój i chłodny okład pomagają większości osób, zanim wezmą tabletkę, ale nie zawsze jest to możliwe."), ("pl", "Kładź się spać o stałej porze i zapisuj napady, aby lekarz mógł dobrać leczenie po wizycie."),
    ("it", "Una stanza buia e un panno fresco aiutano la maggior parte delle persone prima di una compressa."), ("pt", "Um quarto escuro e um pano frio ajudam a maioria das pessoas antes de tomar um comprimido."),
    ("sv", "Ett mörkt rum och en sval trasa hjälper de flesta innan de tar en tablett, och det är bra att vila efter det."), ("ru", "Тёмная комната и прохладный компресс помогают большинству людей."),
    ("zh", "多数人先在暗室里冷敷，再服药。"), ("ja", "暗い部屋で冷やしてから薬を飲むと楽になります。"), ("ko", "어두운 방에서 쉬는 것이 도움이 됩니다."), ("ar", "الراحة في غرفة مظلمة تساعد معظم الناس."), ("hi", "अंधेरे कमरे में आराम करने से अधिकतर लोगों को मदद मिलती है।"),
]


def rates(found, wanted):
    hit = len(found & wanted)
    return hit / len(wanted), hit / max(1, len(found))


def test_refusals():
    found = {t for t in REFUSALS + ANSWERS if P.is_refusal(t)}
    recall, precision = rates(found, set(REFUSALS))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, set(REFUSALS) ^ found)


def test_languages():
    cases = {(ql, i): (Q[ql], t, lang) for ql in Q for i, (lang, t) in enumerate(TEXTS)}
    found = {k for k, (q, t, _) in cases.items() if P.is_foreign(q, t)}
    recall, precision = rates(found, {k for k, (_, _, lang) in cases.items() if lang != k[0]})
    assert recall >= 0.9 and precision >= 0.98, (recall, precision)


def test_long_tags_show_nothing():
    assert P.is_empty('<div class="' + "x" * 300 + '"></div>') and not P.is_empty("5 < 6")
