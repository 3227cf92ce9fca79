"""Texts for the recall of problem 1 on what no list and no training example holds: names, streets, numbers, addresses.

``cases()`` yields (kind, text, item). Every given and family name below is absent from ``personal.GIVEN_NAMES`` and from the
training lists (``test_personal`` checks that), as is every sentence.
"""

GIVEN = (
    "Kerstin Brendan Marjorie Alasdair Ramona Trevor Nicolette Dominik Ewa Giselle Harriet Ignacio Jolanda Lothar Mirela Norbert Orla Pascal Rosamund Siegfried Tatiana Ulrich Valentina Wendy "
    "Yolanda Zdenek Améline Benedetta Cécile Désirée Ernesto Fabiola Gerardo Heloísa Jürg Käte Lídia Mélanie Núria Óðinn"
).split()
FAMILY = (
    "Kerrigan Ashdown Fotheringay Mulvaney Prendergast Whitlock Abernathy Okafor Bjornstad Castellani Drummond Eberhardt Fassbinder Grabowski Hofstadter Iturbe Jaramillo Kasprzak Lindqvist Montalbán "
    "Nakamura Oberlechner Pasquier Quiroga Rautenbach Szymański Trevelyan Uhlenbrock Vandevelde Weatherby Zubizarreta Brémond Château Delacroix Etxeberria Figueiredo Großmann Hägele Ísfeld Jönsson"
).split()
NAME_FRAMES = (
    "The keynote was given by {n} on the second day.", "We are grateful to {n} for the photographs.", "{n} missed the bus and walked.", "Please book a room for {n}, arriving late.",
    "> {n} <{a}> wrote:\n> fine", "From: {n}\nSubject: lunch", "{n} {a}", "All the best\n{n}", "Das Gutachten hat {n} unterschrieben.", "{n} sitzt heute im Nebenzimmer.", "Le dossier médical de {n} est complet.",
    "{n} a gagné la course.", "El discurso de {n} fue largo.", "{n} perdió las llaves.", "O discurso de {n} foi longo.", "{n} perdeu as chaves.",
)
STREETS = (
    "221 Elm Parkway", "14 Orchard Lane", "7b Quarry Hill Road", "1180 Sunset Boulevard", "36 Old Mill Drive", "Flat 2, 9 Canal Street", "55 Harbour View", "Am Markt 5", "Lindenallee 44", "Goethestraße 17a", "An der Mühle 3", "Kirchplatz 9",
    "Zum Bergwerk 12", "Alter Postweg 28", "Bahnhofstr. 61", "12 rue Lafayette", "5 bis avenue Foch", "88, boulevard Voltaire", "3 impasse des Tilleuls", "27 chemin du Moulin", "Calle Mayor 15", "C/ Serrano nº 40", "Avda. de América 102",
    "Plaza del Carmen, 8", "Paseo Colón 31", "Rua Augusta 250", "Travessa das Flores 6", "Praça da Figueira, 14", "Largo do Rato 3", "Via Roma 12", "Piazza Navona 3", "Corso Garibaldi 77",
)
STREET_FRAMES = ("Our new flat is at {s}, top floor.", "The parcel goes to {s}.", "Wir treffen uns: {s}, hinten.", "Rendez-vous au {s}.", "Nos vemos en {s} a las seis.", "Encontro na {s}, às seis.", "Home: {s}\n", "{s}\n")
PHONES = (
    "+44 1632 960483", "01632 960 751", "+1 (415) 555-0132", "(212) 555-0178", "646.555.0110", "+49 151 23456789", "0171/4455667", "tel (0)30 901820", "030-5678901", "+33 6 12 34 56 78", "07 98 76 54 32", "+34 612 345 678", "+351 912 345 678",
    "+39 06 4567 8901", "+41 44 668 18 00", "+43 1 58858", "0049 89 123456",
)
PHONE_FRAMES = ("Give me a ring: {x}.", "Phone {x}", "My cell is {x}, after six.", "Telefon {x}", "Erreichbar unter {x}.", "Téléphone : {x}", "Teléfono {x}", "Telefone: {x}", "\n{x}\n")
IDS = (
    "078-05-1120", "219 09 9999", "QQ 12 34 56 C", "AB123456D", "86 095 742 719", "65929970489", "1 84 12 76 451 089 46", "2 55 08 14 168 025 38", "12345678Z", "X1234567L", "12.345.678-Z", "501964843", "123 456 789",
)
ID_FRAMES = ("Social security number: {x}", "The passport says {x}.", "SSN {x}", "National ID {x}", "Die Steuernummer ist {x}.", "Ausweis: {x}", "Numéro de sécurité sociale : {x}", "Mi DNI: {x}", "Meu NIF é {x}.", "Tax number {x}")
EMAILS = ("k.ashdown@brightmail.example", "fotheringay_w@uni.example.org", "orla77@post.example", "info@bakery.example", "m.pasquier (at) labo.example", "jolanda [at] werk.example", "brendan at shop dot example", "N.GRABOWSKI@FIRM.EXAMPLE")
EMAIL_FRAMES = ("Reach me through {x} please.", "Kontakt: {x}", "<{x}>", "Écrivez à {x}.", "Mi correo es {x}", "{x}\n")


def cases():
    k = 0
    for g, f in [(g, FAMILY[(i * 7 + j * 11) % len(FAMILY)]) for i, g in enumerate(GIVEN) for j in range(4)]:
        for shape in (f"{g} {f}", f"{f}, {g}", f"{g} T. {f}", f"{g[0]}. {f}", f"{g} {f.upper()}"):
            frame = NAME_FRAMES[k % len(NAME_FRAMES)]
            k += 1
            if shape.startswith(f + ",") and "{a}" not in frame and "From" not in frame:
                continue  # a family name first, within a sentence, is no usual way to write
            yield "person_name", frame.format(n=shape, a=f"{g[0].lower()}{k}x@host.example"), shape
    for items, frames, kind in ((STREETS, STREET_FRAMES, "street_address"), (PHONES, PHONE_FRAMES, "phone"), (IDS, ID_FRAMES, "id_number"), (EMAILS, EMAIL_FRAMES, "email")):
        for i, x in enumerate(items):
            for frame in frames:
                yield kind, frame.replace("{s}", x).replace("{x}", x), x.removeprefix("tel ")
