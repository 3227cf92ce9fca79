"""Labelled examples for the models of ``personal``, composed with a fixed seed; none of the data to be searched goes in.

Names are drawn from public names, three in four of them outside the list the models see as a feature, and
from syllables; sentences are frames of everyday mail in five languages around them. Whatever the generators
propose in an example and no frame marks is a negative, so sentence starts, nouns, places, titles, roles and
function mailboxes are learnt as such. ``ROWS`` bounds the number of examples of each kind, whatever the size
of the data to be searched.
"""

from __future__ import annotations

import random
import re

from postmill.llm.boosting import Boosted, fit
from postmill.llm.garbled import CHAINS, garble
from postmill.llm.personal import _ODD, GIVEN_NAMES, KINDS, candidates

ROWS = {"email": 1800, "phone": 2600, "id_number": 2600, "street_address": 2600, "person_name": 12000}
SEED = 20

# Given names outside the feature list, family names, and ordinary words, for the examples.
_GIVEN = (
    "Aaron Abigail Adele Alistair Bethany Bruno Caleb Clara Declan Dorothy Eleanor Elliot Fergus Freya Gavin Graham Imogen Isaac Jasper Leah Logan Maeve Naomi "
    "Oscar Phoebe Quentin Rosalind Rupert Saskia Tobias Violet Zachary Annika Benedikt Cornelia Friederike Gerlinde Gottfried Hartmut Jörg Katrin Ludger Mareike "
    "Ottilie Reinhard Sönke Tanja Volker Wiebke Adélaïde Aymeric Bastien Clément Delphine Édouard Gaëtan Hervé Josiane Léon Maxime Océane Romain Séverine Thierry "
    "Valérie Yann Adrián Blanca Consuelo Emilio Estefanía Gonzalo Íker Jimena Leandro Mónica Nicolás Óliver Rocío Sebastián Ximena Afonso Bárbara Catarina Duarte "
    "Estêvão Fátima Gaspar Helena Joaquim Leonor Mafalda Otávio Raquel Salvador Vasco Alessia Bartolomeo Chiara Enrico Matteo Agnieszka Bogdan Nadia Yusuf Aisha Priya Wei Hiroshi".split()
)
_FAMILY = (
    "Smith Jones Taylor Brown Wilson Johnson Davies Wright Walker Thompson Hughes Edwards Green Hall Clarke Jackson Wood Turner Baker Cooper Morris Bailey Murphy "
    "O'Brien Kelly Campbell MacDonald Stewart Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann "
    "Schwarz Zimmermann Krüger Lehmann Köhler Böhm Martin Bernard Dubois Durand Moreau Lefèvre Girard Mercier Bonnet Rousseau Fournier Gauthier Chevalier Lemaître "
    "García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Díaz Moreno Muñoz Álvarez Romero Navarro Torres Vázquez Castaño Silva Santos Ferreira "
    "Pereira Oliveira Costa Rodrigues Martins Sousa Gonçalves Almeida Carvalho Araújo Magalhães Simões Rossi Bianchi Ricci Esposito Kowalski Nowak Novák Horváth "
    "Jansen Bakker Andersson Nilsson Larsen Hansen Yılmaz Popescu Petrov Ivanova Khan Patel Nguyen Tanaka".split()
)
_NOUNS = {
    "en": "Account Project Report Meeting Team Office Manager Sales Support Group Company Library Hotel Report Budget Contract Holiday Kitchen Parking Training Website Server Database Printer Garden Committee Schedule Shipment Engine Review".split(),
    "de": "Bericht Rechnung Vertrag Angebot Termin Abteilung Sitzung Kunde Projekt Vorschlag Anfrage Firma Haus Auto Schule Bahnhof Drucker Küche Urlaub Kasse Konto Übergabe Öffnung Äußerung Maschine Werkstatt Zeitung Straßenbahn".split(),
    "fr": "Rapport Facture Contrat Réunion Équipe Projet Budget École Bureau Clé Séance Affiche Étude Gare Panier Chantier Mairie Rentrée".split(),
    "es": "Informe Factura Contrato Reunión Equipo Proyecto Presupuesto Oficina Llave Sesión Almacén Reforma Billete Cocina Época".split(),
    "pt": "Relatório Fatura Contrato Reunião Equipa Projeto Orçamento Escritório Chave Sessão Edição Cozinha Armazém Época".split(),
}
_FRAMES = {
    # {n} a name, {g} a given name alone, {N} {M} nouns, {P} a place, {w} a short sentence
    "en": (
        "The {r} closes early.", "It went to the {r}.", "A note of the {r}: {w}", "The {r} wrote about {P}.", "{N} {c} is closed.", "{N} {c}-4 was late.",
        "I met {n} at the station.", "Phone {n} about the {m}.", "Let {n} know.", "I had tea with {n} yesterday.", "Write to {n} today.", "{n} will call you back.", "Could you forward this to {n} please?", "According to {n} the {m} is late.", "We hired {n} last year.",
        "Invite {n}, {n} and the others.", "{n} and I agreed on it.", "Has anyone heard from {n}?", "Tell {n} about it.", "The {m} was written by {n}.", "Remind {n} of the {m}.",
        "Yours,\n{n}", "Ask for {n} at the front.", "My name is {n}.", "A note from {n}: {w}", "Signed: {n}", "Send {g} the {m}.", "{g} is away in {P}.",
        "The {P} {N} opens soon.", "Our {N} {M} has moved.", "{N} {M}: see page 3.", "Check the {P} {m} first.", "Between {P} and {P} it rains.", "When {P} closes, {P} opens.",
        "Hi {g}, {w}", "Dear {g},\n\n{N} news.", "{g}\n{N} {m}, {P}", "Thanks {g}! {N} done.", "Nobody in {P} has seen the {m}.", "{P} closes on Friday. {N} stays.", "Attached: {N} {M}.",
        "Tomorrow {g} visits {P}.", "The new {m} needs {P} before May.", "{P} pays for the {m}.", "Every {m} counts. {P} knows.",
    ),
    "de": (
        "{N} {c} ist weg.", "Der {r} {P} ist zu.",
        "Ich traf {n} am Bahnhof.", "{n} ruft zurück.", "Kannst du das an {n} weiterleiten?", "Laut {n} ist der {N} fertig.", "Frag {n} nach dem {N}.", "Der {N} stammt von {n}.",
        "Bis bald\n{n}", "{n} und ich sind dabei.", "Hat jemand {n} gesehen?", "Mein Name ist {n}.", "Gib {g} den {N}.", "Der {N} liegt in {P}.", "Die {N} aus {P} fehlt.", "Neue {N} {M} ab Mai.",
        "{g}\n{N} und {M}, {P}", "Hallo {g},\n\n{N} folgt.", "Am {N} steht die {M}.", "Für {P} gibt es keine {N}.", "{P} hat die {N} bezahlt.", "{N} statt {M}!", "Der {N} {P} bleibt zu.", "Wann kommt {n} nach {P}?",
        "Danach schließt {P} die {N}.", "Im {N} von {P} fehlt {n}.",
    ),
    "fr": (
        "J’ai croisé {n} à la gare.", "{n} vous rappellera.", "Peux-tu transmettre à {n} ?", "Selon {n}, le {m} est prêt.", "Demande à {n}.", "Le {m} vient de {n}.", "À bientôt\n{n}", "{n} et moi sommes d’accord.",
        "Je m’appelle {n}.", "Donne le {m} à {g}.", "Le {m} de {P} est fermé.", "{P} ferme lundi.", "{N} {P} : voir page 3.", "{g}\n{N} et {m}, {P}", "Bonjour {g},\n\n{N} suit.", "La réunion de {P} avec {n} est reportée.", "L’{m} de {P} manque.",
    ),
    "es": (
        "Me encontré con {n} en la estación.", "{n} te llamará.", "¿Puedes reenviarlo a {n}?", "Según {n} el {m} está listo.", "Pregunta a {n}.", "El {m} es de {n}.", "Hasta pronto\n{n}", "{n} y yo de acuerdo.",
        "Me llamo {n}.", "Dale el {m} a {g}.", "El {m} de {P} está cerrado.", "{P} cierra el lunes.", "{N} {P}: ver página 3.", "{g}\n{N} y {m}, {P}", "Hola {g},\n\n{N} sigue.", "La reunión de {P} con {n} se aplaza.",
    ),
    "pt": (
        "Encontrei {n} na estação.", "{n} vai ligar de volta.", "Podes reenviar a {n}?", "Segundo {n} o {m} está pronto.", "Pergunta a {n}.", "O {m} é de {n}.", "Até breve\n{n}", "{n} e eu concordamos.",
        "Chamo-me {n}.", "Dá o {m} a {g}.", "O {m} de {P} está fechado.", "{P} fecha na segunda.", "{N} {P}: ver página 3.", "{g}\n{N} e {m}, {P}", "Olá {g},\n\n{N} segue.", "A reunião de {P} com {n} foi adiada.",
    ),
}
_PLAIN = {
    "en": ("The lift is broken again.", "Lunch is at noon, bring the papers.", "It took 40 minutes and 12 people.", "Nobody answered so far."),
    "de": ("Der Aufzug steht wieder still.", "Mittags gibt es Suppe im Hof.", "Es dauerte 40 Minuten.", "Die Antwort kommt später."),
    "fr": ("Le train avait du retard.", "Il faut rappeler demain.", "Cela a duré 40 minutes.", "La réponse viendra plus tard."),
    "es": ("El tren llegó tarde.", "Hay que llamar mañana.", "Duró 40 minutos.", "La respuesta llegará luego."),
    "pt": ("O comboio chegou tarde.", "É preciso ligar amanhã.", "Demorou 40 minutos.", "A resposta vem depois."),
}
_SAID = {"en": ("wrote:", "writes:", "said:", "wrote the following:"), "de": ("schrieb:", "schreibt:"), "fr": ("a écrit :", "écrit :"), "es": ("escribió:", "escribe:"), "pt": ("escreveu:", "escreve:")}
_FROM = {"en": ("From", "To", "Cc"), "de": ("Von", "An", "Kopie"), "fr": ("De", "À", "Copie"), "es": ("De", "Para", "Copia"), "pt": ("De", "Para", "Copia")}
_ROLES = "Accounts Support Team|Weekly Digest|Info Desk|Customer Service|System Notification|Mailing List|Human Resources|Central Booking|Sales Department|Web Admin|News Letter|Front Office|Ticket Robot|Backup Monitor|Service Center|Kunden Dienst|Service Client|Reserva Central|Night Watch|Stock Alerts".split("|")
_CLOSE = {"en": ("Best,", "Regards,", "Cheers"), "de": ("Viele Grüße", "Gruß"), "fr": ("Cordialement,", "Bien à vous,"), "es": ("Saludos,", "Un saludo"), "pt": ("Cumprimentos,", "Abraço")}


def _letters(r: random.Random, n: int) -> str:
    return "".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(n))


def _digits(r: random.Random, pattern: str) -> str:
    return "".join(str(r.randrange(10)) if c == "9" else str(r.randrange(1, 10)) if c == "8" else r.choice("ABCDEFGHJKLMNPRSTWXYZ") if c == "A" else c for c in pattern)


def _syllables(r: random.Random, low: int, high: int) -> str:
    parts = ["".join((r.choice(["b", "br", "c", "cl", "d", "dr", "f", "fl", "g", "gr", "h", "k", "l", "m", "n", "p", "pr", "qu", "r", "s", "st", "t", "th", "tr", "v", "w", "z", ""]),
                      r.choice(["a", "e", "i", "o", "u", "ea", "ou", "ie", "ä", "ö", "ü", "é", "ã", "á", "í", "ó"] if r.random() < 0.3 else ["a", "e", "i", "o", "u", "ea", "ou"]),
                      r.choice(["", "l", "n", "r", "s", "t", "m", "nd", "rt", "x", "ck", "lt"]))) for _ in range(r.randint(low, high))]
    word = "".join(parts)
    return word[0].upper() + word[1:] if len(word) > 2 else word.upper() + "an"


def _given(r: random.Random) -> str:
    roll = r.random()
    name = r.choice(_LISTED) if roll < 0.25 else r.choice(_GIVEN) if roll < 0.8 else _syllables(r, 1, 2)
    return f"{name}-{r.choice(_GIVEN)}" if r.random() < 0.03 else name


_LISTED = sorted(GIVEN_NAMES)
_COMPOUND = (
    "ham wick bury hurst stead gate brook land worthy thwaite by bottom shaw field heim hausen kamp horst brück wald städt rode villier fontaine mont bois champ vieille "
    "torre puente iglesia campo cal velho ribeiro pinho cast mar sol guer sand hol ock lang hart bren"
).split()


def _family(r: random.Random) -> str:
    roll = r.random()
    name = r.choice(_FAMILY) if roll < 0.4 else _syllables(r, 2, 3) if roll < 0.7 else (r.choice(_COMPOUND) + r.choice(_COMPOUND)).capitalize()
    return f"{name}-{r.choice(_FAMILY)}" if r.random() < 0.03 else name


def _code(r: random.Random) -> str:
    return _letters(r, r.choice([2, 2, 3, 3, 4])).upper()


def _place(r: random.Random) -> str:
    return _syllables(r, 2, 3)


def _plain_ascii(word: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if "a" <= c <= "z")


def _address(r: random.Random, given: str, family: str) -> str:
    g, f = _plain_ascii(given) or "x", _plain_ascii(family) or "y"
    local = r.choice([f"{g}.{f}", f"{g[0]}.{f}", f"{g}{f[0]}{r.randrange(10, 99)}", f"{f}.{g}", f"{f}_{g}", f"{g}-{f}", f"{f}.{r.randrange(99)}", g, f"{g[0]}{f}", f"{_letters(r, 6)}"])
    return f"{local}@{r.choice(['', 'mail.', 'smtp.', 'web.'])}{_letters(r, 6)}.{r.choice(['com', 'org', 'example', 'test', 'net', 'de', 'fr'])}"


def _email(r: random.Random) -> list:
    lang = r.choice(list(_PLAIN))
    given, family = _given(r), _family(r)
    true = _address(r, given, family)
    if r.random() < 0.15:
        true = f"{r.choice(['info', 'sales', 'office', 'list', 'help', 'team', 'stock'])}@{true.split('@')[1]}"
    host = true.split("@")[1]
    roll = r.random()
    if roll < 0.24:  # a Message-ID
        local = r.choice([f"{_letters(r, 7)}.{r.randrange(99999)}", f"{r.randrange(10**8)}.{r.randrange(9999)}.{_letters(r, 4)}", f"{r.randrange(16**10):x}", f"{_letters(r, 3)}{r.randrange(10**6)}"])
        return [r.choice(["cf. ", "Message-ID: ", "In-Reply-To: ", "References: ", "siehe ", "voir ", "ver ", "see ", "ref: ", "\n"]), f"<{local}@{r.choice(['mx', 'mx1', 'mx22', 'mta2', 'smtp', 'localhost'])}.{host}>", r.choice([" there.", ".", "\n", " (old)"])]
    if roll < 0.32:
        return [f"https://{host}/{_letters(r, 4)}/{true} "]
    if roll < 0.4:
        return [f"Come at {r.randrange(1, 12)} or at {_letters(r, 6)}. We stay at {_letters(r, 5)}.{_letters(r, 4)} until late "]
    form = r.random()
    if form > 0.6:
        local = true.split("@")[0]
        true = (
            f"{local} @ {host}" if form < 0.7 else f"{local} {r.choice(['(at)', '[at]', '(AT)', '{at}'])} {host}" if form < 0.85 else
            f"{local} {r.choice(['at', 'arroba'])} {host.replace('.', r.choice([' dot ', ' punkt ', ' point ', ' punto ', ' ponto ']))}"
        )
    if r.random() < 0.1:
        true = true.upper()
    lead = r.choice([f"{given} {family} <", f"{given} ", r.choice(_FROM[lang]) + ": ", "mail: ", "", "> ", "write to ", "<", "\n", "\n<", f"{family}, {given} <"])
    return [lead, (true, "email"), ">" if lead.endswith("<") else r.choice([f" {r.choice(_SAID[lang])}", "", ".", "\n"])]


# Ways to write numbers of the numbering plans of several countries; 9 any digit, 8 one from 1, A a letter.
_PHONES = (
    "+44 89 9999 9999|089 9999 9999|+44 (0)89 99999999|08999 999999|+44 8999 999999|(899) 899-9999|899-899-9999|899.899.9999|1.899.899.9999|+1 899 899 9999|+1-899-899-9999|"
    "0899/9999999|0899 9999999|089 99999 99|089 99999-99|089/999999|+49 89 9999999|+49 (0)899 9999-99|(0)89 999999|0049 89 999999|+49 8999 999999|0033 8 99 99 99 99|"
    "+33 8 99 99 99 99|08.99.99.99.99|08 99 99 99 99|+33 (0)8 99 99 99 99|0034 899999999|899 99 99 99|+34 899 999 999|899 999 999|+351 899 999 999|00351 899999999|"
    "+39 08 9999 9999|+41 89 999 99 99|+31 89 9999999|+43 8 9999999|899 99 99|899-9999|+46 89 999 99 99"
).split("|")
# Ways to write identity, social security and tax numbers of several countries.
_IDS = (
    "899-99-9999|899 99 9999|AA899999A|AA 89 99 99 A|89999999999|89 999 999 999|1 89 89 89 999 999 99|289899999999999|1 89 89 89 999 999|2 89 89 2A 999 999 99|"
    "89999999-A|89.999.999-A|89999999A|89 999 999 A|X8999999A|Y-8999999-A|899999999|899 999 999|A8999999A|89 999999 A 999|AAA AAA 89A99 A999A|899999999999"
).split("|")
_PHONE_LEADS = "Tel |Tel: |T: |T |☎ |Phone: |call |Call me on |My mobile is |Fax |Mobil |Handy: |Tel.: |Telefon |Durchwahl |ruf an: |Tél. |Tél : |Portable : |appelle le |Teléfono: |Móvil |llama al |Telefone: |Telemóvel |liga para o |dial |text me at |\n|".split("|")
_ID_LEADS = (
    "SSN |SSN: |social security number |My insurance number is |National Insurance no. |tax ID |passport |ID: |ID number |Steuer-ID |meine Steuernummer: |Personalausweis |Sozialversicherung: |Steuernummer lautet |"
    "numéro de sécurité sociale : |Mon NIR est le |N° fiscal : |carte d’identité |DNI |DNI: |mi NIE es |NSS |número de identidad |Documento: |NIF |o meu NIF é o |contribuinte |Cartão de cidadão: |for the records: |as requested: |hier die Angabe: |"
    "voici le mien : |aquí está: |segue o meu: |the one you wanted: "
).split("|")
_OTHERS = "8999 9999|A-999-9999|A899999/99|AA-89999|#8999|v8.99.99|20{}-0{}-1{}|1{}/0{}/20{} 1{}:2{}|1{}.0{}.2{}|9999-99|#89999999|1{}.0{}.20{}|89999 99|8999999|89999999|999.999|89-9999-99|8.999.999|8999-9999|89 999 pcs".split("|")
_OTHER_LEADS = (
    "part |item |room |invoice |Invoice no. |order number |ticket #|page |serial |Rechnung |Auftrag Nr. |Charge |Seite |commande |facture n° |page |pedido |factura |lote |encomenda |fatura |lot |LOT |Ref. |ref |version |build |case |"
    "dossier n° |Akte |processo |on |am |le |em |el |Date: |phone case |tax form |id tag |text file |social club |order |number |Nummer |Artikel "
).split("|")


def _wrapped(r: random.Random, lead: str) -> str:
    """The lead, now and then with a line break for its last blank."""
    return lead[:-1] + r.choice(["\n", "\n> ", "\r\n"]) if lead.endswith(" ") and len(lead) > 1 and r.random() < 0.2 else lead


def _numbers(r: random.Random) -> list:
    roll = r.random()
    phone = lambda: _digits(r, r.choice(_PHONES))

    def identity() -> str:
        form = r.choice(_IDS)
        value = _digits(r, form.replace("8", "9") if r.random() < 0.5 else form.replace("8", "0", 1) if r.random() < 0.4 else form)
        return value[:-1] + r.choice("ABCD") if form.startswith("AA8") or form.startswith("AA ") else value

    if roll < 0.1:  # nothing but the format tells
        return ["\n", (phone(), "phone"), "\n"]
    if roll < 0.16:
        return [r.choice(["please use ", "mine is ", "oder ", "ou ", "o ", "my other one: "]), (_digits(r, r.choice([x for x in _PHONES if x[0] in "+0(1"])), "phone"), r.choice([".", " today"])]
    if roll < 0.22:
        form = r.choice(["AA899999A", "AA 89 99 99 A", "89999999-A", "89.999.999-A", "89999999A", "899-99-9999", "89 999 999 999", "1 89 89 89 999 999 99", "X8999999A"])
        return [r.choice(["it is ", "das ist ", "c’est ", "es ", "é ", "there: "]), (_digits(r, form.replace("8", "9") if r.random() < 0.5 else form), "id_number"), r.choice([".", " today"])]
    if roll < 0.42:
        return [_wrapped(r, r.choice(_PHONE_LEADS)), (phone(), "phone"), r.choice([" works", " after lunch.", ".", "\n", " erreichbar.", ", thanks", " ce soir", ""])]
    if roll < 0.68:
        return [_wrapped(r, r.choice(_ID_LEADS)), (identity(), "id_number"), r.choice([" The form", ".", "\n", " for the file.", ", ok?", ""])]
    form = r.choice(_OTHERS)
    while "{}" in form:
        form = form.replace("{}", str(r.randrange(1, 9)) if "20{}" not in form[: form.find("{}") + 2] else str(r.randrange(20, 29)), 1)
    text = form if form[:2] == "20" or "/" in form or ":" in form else _digits(r, form)
    return [r.choice(_OTHER_LEADS), text, r.choice([" is done.", ". 53 of 5 rows", ", he wrote:", "\n", " at 10:30"])]


# Frames for streets, X a name, N a number.
_STREETS = (
    "N X Street|N X Lane|N X Road|N X Close|N X Avenue|N X Drive|N X Way|N X Court|N X Terrace|N X Parkway|Nb X Lane|Flat 3, N X Close|Apt 5, N X X Street|N Old X Road|N X Rd|N X St.|N X Blvd|N X Trail|N X X Circle|"
    "Xstraße N|Xstrasse N|Xgasse N|Xweg Na|Xstr. N|Xplatz N|Xallee N|Alte X Straße N|Xer Str. N|Xer Weg N|Am X N|An der X N|Im X N|Zum X N|Unter den X N|Xring N b|Xdamm N|Xufer N|"
    "N, avenue de X|N rue de X|N bis rue du X|N chemin des X|N, place de X|N quai de X|N boulevard X|N, allée des X|N rue X X|N impasse du X|N ter, route de X|N cours X|"
    "C/ X N|Calle X N|Plaza de X nº N|Avda. X N|Avenida de la X, N|Paseo del X N|Camino de X N|Calle X X nº N|Ronda de X N|"
    "Rua da X N|Rua X, N|Travessa do X N|Av. X N|Praça de X, N|Largo do X N|Estrada da X nº N|Alameda X N|Via X N|Piazza X N|Corso X N|Viale X N"
).split("|")
_STREET_LEADS = "We live at |Our office moved to |Deliver it to |come to |address: |Adresse: |Ich wohne in der |Wir ziehen in die |Lieferung an: |Treffpunkt: |J’habite |Nous serons au |Adresse : |Livraison au |Vivo en |Estamos en |Dirección: |La cita es en |Moro na |Estamos na |Morada: |\n|\n> |".split("|")


def _street(r: random.Random) -> list:
    lang = r.choice(list(_NOUNS))
    n = str(r.choice([r.randrange(1, 30), r.randrange(1, 220), r.randrange(1, 2000)]))
    if r.random() < 0.66:
        form = r.choice(_STREETS)
        while "X" in form:
            form = form.replace("X", r.choice([_place(r), r.choice(_FAMILY), r.choice(_NOUNS[lang]), (r.choice(_COMPOUND) + r.choice(_COMPOUND)).capitalize()]), 1)
        form = form.replace("N", n, 1) if not form.startswith("N") else n + form[1:]
        return [r.choice(_STREET_LEADS), (form, "street_address"), r.choice([f", {_digits(r, '89999')} {_place(r)}", ".", "\n", f" in {_place(r)}", f", {_place(r)}", " since May"])]
    x, noun, noun2 = _place(r), r.choice(_NOUNS[lang]), r.choice(_NOUNS[lang])
    return [r.choice([
        f"{n} {noun}s and more", f"{n} {x} pieces", f"{noun} {n}", f"{noun} {x} {n}", f"on {n} May", f"Am {n}. März", f"le {n} mars", f"{x} {n}, {x} {n}", f"Room {n}", f"Page {n} of {noun} {n}", f"{n} {noun} {noun2}", f"the {noun} {n} way",
        f"Seite {n}", f"Version {n}", f"{noun} Nr. {n}", f"Il y a {n} {noun}s", f"{n} de {x}", f"at {n} {noun}", f"We need {n} {noun}", f"Im {noun} {n} Stück", f"Am {noun} {n} Leute", f"{x} has {n} {noun}", f"von {n} {noun}", f"Lot {n} {n} Way", f"{n} unités côté cours, {x}",
        f"Gate {n} Close it", f"in {_code(r)} {n} {n}", f"{noun} {_code(r)} {n}", f"{noun} {_code(r)} {n} {n}", f"at {n} °C. {noun}", f"{n} rows. Place {x}", f"Level {n} Parking", f"Tuesday {n}", f"In {x} {n}",
    ]), r.choice([" ", ".", "\n", " left", " und"])]


def _form(r: random.Random, given: str, family: str) -> str:
    shape = r.random()
    if shape < 0.07:
        family = family.upper()
    elif shape < 0.1:
        given, family = given.upper(), family.upper()
    elif shape < 0.26:
        given, family = given.lower(), family.lower()
    if r.random() < 0.15 and given != given.upper():
        return r.choice([f"{given[0].upper()}. {family}", f"{family}, {given[0].upper()}.", f"{given[0].upper()}. {family}"])
    return r.choice([f"{given} {family}"] * 8 + [f"{family}, {given}", f"{family}, {given}", f"{given} {r.choice('ABEKMTJRS')}. {family}", f"{family} {given}"])


def _name(r: random.Random) -> list:
    lang = r.choice(list(_FRAMES))
    given, family = _given(r), _family(r)
    roll = r.random()
    mark = r.choice(["", "", "> ", "> > ", "| "])
    if roll < 0.55:
        out: list = []
        frames = [r.choice(_FRAMES[lang]) for _ in range(r.choice([1, 1, 2, 3]))]
        low = [x.lower() if lang != "de" else x for x in _NOUNS[lang]]
        for frame in frames:
            text = frame.replace("{w}", r.choice(_PLAIN[lang]))
            while "{" in text:
                i = text.index("{")
                out.append(text[:i])
                what, text = text[i + 1], text[i + 3 :]
                if what == "n":
                    given, family = _given(r), _family(r)
                    out.append((_form(r, given, family), "person_name"))
                else:
                    out.append({"g": _given, "P": _place, "N": lambda r: r.choice(_NOUNS[lang]), "M": lambda r: r.choice(_NOUNS[lang]), "c": lambda r: f"{_code(r)} {r.randrange(9999)}" if r.random() < 0.5 else f"{_code(r)}-{r.randrange(9999)}", "r": lambda r: r.choice(_ROLES).lower(), "m": lambda r: r.choice(low)}[what](r))
            out.append(text + r.choice([" ", " ", "\n", "\n\n"]))
        return _lines(r, out, mark)
    if roll < 0.67:  # headers and lines that introduce a quotation
        date = r.choice([f"{r.randrange(1, 28)}.0{r.randrange(1, 9)}.2{r.randrange(9)}", f"202{r.randrange(9)}-0{r.randrange(1, 9)}-1{r.randrange(9)}, 1{r.randrange(9)}:22", f"{r.randrange(1, 28)}/0{r.randrange(1, 9)}/2025 0{r.randrange(9)}:15"])
        person: str | tuple = _form(r, given, family)
        named = r.random() < 0.8
        if named and r.random() < 0.12 and ". " not in person:  # broken within the name, as mail programs do
            person = person.replace(" ", "\n" + r.choice([mark, "> "]), 1)
        person = (person, "person_name") if named else r.choice([given, r.choice(_ROLES)])
        address = _address(r, given, family)
        tail = r.choice([f" <{address}>", "", f" {address}", f"\n{mark}<{address}>"])
        if r.random() < 0.5:
            lead = r.choice(["On {}, ", "At {}, ", "Am {} schrieb ", "Le {}, ", "El {}, ", "Em {}, ", ""]).replace("{}", date)
            return ["\n" + mark + lead, person, tail + " " + r.choice(_SAID[lang]) + "\n" + mark + "> " + r.choice(_PLAIN[lang]) + "\n"]
        return ["\n" + mark + r.choice(_FROM[lang]) + r.choice([": ", " : "]), person, tail + "\n" + mark + r.choice(["Date: ", "Sent: ", "Datum: "]) + date + "\n" + mark + r.choice(["Subject: ", "Objet : ", "Asunto: ", "Betreff: ", "Assunto: "]) + r.choice(["", "Re: ", "AW: "]) + f"{r.choice(_NOUNS[lang])} {_place(r)}\n"]
    if roll < 0.79:  # closings and signature blocks
        who: str | tuple = (f"{given} {family}", "person_name") if r.random() < 0.6 else given
        role = r.choice([f"{r.choice(_NOUNS[lang])} {r.choice(_NOUNS['en']).lower()}, {_place(r)}", f"{r.choice(_NOUNS[lang])}, {_place(r)}", r.choice(_ROLES), f"{r.choice(_NOUNS[lang])} {r.choice(_NOUNS['en']).lower()}", _address(r, given, family), "Tel +49 30 555", ""])
        return ["\n" + mark + r.choice([r.choice(_CLOSE[lang]), "--", ""]) + "\n" + mark, who, "\n" + mark + role + "\n" + mark + "\n" + mark + r.choice(_NOUNS[lang]) + " " + _place(r) + ". "]
    if roll < 0.93:  # senders and recipients, bare
        out = []
        for _ in range(r.choice([1, 1, 2, 3])):
            given, family = _given(r), _family(r)
            kind = r.random()
            address = _address(r, given, family)
            if kind < 0.7:
                out.append((_form(r, given, family), "person_name"))
            elif kind < 0.8:
                out.append(given)
            elif kind < 0.9:
                out.append(r.choice([r.choice(_ROLES), f"{_place(r)} {r.choice(_NOUNS[lang])}", f"{r.choice(_NOUNS[lang])} {r.choice(_NOUNS[lang])}"]))
                local = r.choice(["info", "bot", "no-reply", "list", _letters(r, 6), "billing", *[re.sub(r"[^a-z]+", r.choice([".", "-", "_", ""]), out[-1].lower())] * 3])
                address = f"{local}@{address.split('@')[1]}"
            out.append((" <{}> " if r.random() < 0.3 else " {} ").format(address))
        return ["", *out]
    return [r.choice([
        f"{given} {_letters(r, 8)}@{_letters(r, 6)}.test", f"{given} {r.choice(_SAID[lang])}", f"{r.choice(_CLOSE[lang])}\n{given}\n{mark}{r.choice(_NOUNS[lang])} {r.choice(_PLAIN[lang])}", f"{r.choice(_NOUNS[lang])}, {given}", f"{given} {r.choice(_NOUNS['en']).lower()}ed it",
        f"{_place(r)} {r.choice(_NOUNS[lang])}", f"{r.choice(_NOUNS[lang])} {_place(r)}", f"{r.choice(_ROLES)} {_letters(r, 5)}@x.test", f"{given} and {given}", f"n° 158, 3º B. {r.choice(_NOUNS[lang])}", f"at 21 °C. {r.choice(_NOUNS[lang])} on", f"{_place(r)}, {_place(r)}", f"{given}, {r.choice(_NOUNS[lang])} {_place(r)}",
    ]), " "]


def _lines(r: random.Random, parts: list, mark: str) -> list:
    """Parts with some blanks turned into the line breaks of wrapped, perhaps quoted, text: now and then inside a name too."""
    width, at, out = r.choice([0, 60, 66, 72]), 0, []
    for p in parts:
        text = p[0] if isinstance(p, tuple) else p
        made, k = "", 0
        for c in text:
            if c == " " and width and at + len((text + " x").split(" ")[made.count(" ") % 7]) > width and at > width - 14:
                made += "\n" + mark
                at = len(mark)
            else:
                made += c
                at = 0 if c == "\n" else at + 1
            k += 1
        out.append((made, p[1]) if isinstance(p, tuple) else made)
    return out


def _example(r: random.Random, kind: str) -> tuple[str, list[tuple[int, int, str]]]:
    parts = {"email": _email, "phone": _numbers, "id_number": _numbers, "street_address": _street, "person_name": _name}[kind](r)
    lang = r.choice(list(_PLAIN))
    bare = parts[0] == ""  # a field of its own, not part of a body
    lead = r.choice(_PLAIN[lang])
    if kind in ("phone", "id_number") and r.random() < 0.35:
        lead = r.choice(["The tag is lost.", "A personal list.", "Text only.", "Call it a day.", "Das Formular ist neu.", "My social life.", "La tarjeta nueva.", "Tax season.", "The insurance letter."])
    if not bare:
        parts = [lead + r.choice([" ", "\n", "\n\n"]), *parts, r.choice(["", " "]) + r.choice(_PLAIN[lang])]
    if r.random() < (0.2 if kind == "person_name" else 0.12):  # decoded with the wrong encoding, as a whole
        chain = r.choice(CHAINS)
        bad = [garble(p[0] if isinstance(p, tuple) else p, chain) for p in parts]
        if all(b is not None and "�" not in b for b in bad):
            parts = [(b, p[1]) if isinstance(p, tuple) else b for b, p in zip(bad, parts)]
    text, spans = "", []
    for p in parts:
        if isinstance(p, tuple):
            spans.append((len(text), len(text) + len(p[0]), p[1]))
            p = p[0]
        text += p
    return text, spans


def _same(a: int, b: int, x: int, y: int, kind: str) -> bool:
    if kind == "street_address":
        return max(a, x) < min(b, y) and min(b, y) - max(a, x) >= 0.6 * max(b - a, y - x)
    return abs(a - x) <= 1 and abs(b - y) <= 1


def _record(r: random.Random, text: str, spans: list) -> str:
    """Local parts of the record's other addresses: now and then those of the persons named."""
    if r.random() < 0.6:
        return ""
    names = [[_plain_ascii(w) or "x" for w in _WORDS.findall(text[a:b])] for a, b, kind in spans if kind == "person_name"]
    locals_ = [r.choice([".".join(n), "_".join(reversed(n)), n[0] + n[-1][0], f"{n[0][0]}.{n[-1]}"]) for n in names if n and r.random() < 0.7]
    return " ".join([*locals_, f"{_letters(r, 5)}.{_letters(r, 6)}"])


def _book(r: random.Random, text: str, spans: list) -> frozenset[str]:
    """What a corpus's headers could have taught of this example's words: most names, now and then another word."""
    likely = r.choice([0.0, 0.0, 0.6, 0.9])
    known = set()
    for a, b, kind in spans:
        if kind == "person_name":
            known.update(w for w in _WORDS.findall(text[a:b].lower()) if r.random() < likely)
    stray = r.choice([0.0, 0.0, 0.03, 0.1])
    known.update(w for w in _WORDS.findall(text.lower()) if r.random() < (0.5 * likely if w in _ROLE_WORDS or w in _ALONE else stray))
    return frozenset(x for w in known for x in (w, _ODD.sub("~", w)))


_WORDS = re.compile(r"[^\W\d_][^\W\d_'\-]+")
_ROLE_WORDS = frozenset(w.lower() for role in _ROLES for w in role.split())
_ALONE = frozenset(w.lower() for w in (*GIVEN_NAMES, *_GIVEN))


def labelled(kind: str, rows: int | None = None, seed: int = SEED) -> tuple[list[tuple], list[int]]:
    """Feature rows and labels of the candidates in composed examples."""
    r = random.Random(f"{seed}-{kind}")
    x, y = [], []
    for _ in range(rows or ROWS[kind]):
        text, spans = _example(r, kind)
        for k, a, b, row in candidates(text, _record(r, text, spans), _book(r, text, spans)):
            if k == kind:
                x.append(row)
                y.append(int(any(k == s and _same(a, b, p, q, kind) for p, q, s in spans)))
    return x, y


def fit_models(rows: dict[str, int] | None = None, seed: int = SEED) -> dict[str, Boosted]:
    return {kind: fit(*labelled(kind, (rows or ROWS)[kind], seed)) for kind in KINDS}
