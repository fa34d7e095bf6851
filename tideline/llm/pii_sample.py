"""A small labelled sample for problem 7: sentences written and marked by hand, with slots that are filled by rule.

What fills a slot follows public formats: numbering plans, identity documents, street names, and the commonest names of
several countries. A quarter of the given names are made up, so that titles and labels are learnt and not only lists; street,
family and place names are made up throughout. No text of any corpus is used.
"""

from __future__ import annotations

import random
import re

# Common given names of English, German, Spanish and French speaking countries, in the order of the alphabet.
GIVEN = (
    "Adam Alan Alejandro Alexander Alice Amanda Amelia Amy Ana Andrea Andreas Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Bernd "
    "Brian Carlos Carmen Carol Caroline Charles Charlotte Christian Christina Christine Christopher Claire Claudia Cristina Daniel David Deborah Diana Diego "
    "Dorothy Edward Elena Elisabeth Elizabeth Emily Emma Eric Eva Fatima Felix Fernando Francisco Frank Gabriel George Hannah Hans Heike Helen Henry "
    "Ian Isabel Jack Jacob James Jan Jane Javier Jean Jennifer Jessica Jim Joan Johanna John Jonas Jonathan Jorge Jose Joseph Joshua Juan Juergen Julia "
    "Karen Karin Karl Katharina Kevin Klaus Laura Lena Linda Lisa Louis Lucas Luis Manuel Margaret Maria Marie Mark Markus Marta Martin Mary Matthew Maximilian "
    "Megan Mehmet Michael Miguel Mohammed Monika Nicole Nina Nora Olivia Oliver Pablo Patricia Patrick Paul Paula Pedro Peter Philip Pierre Rachel Rafael Ralf Rebecca "
    "Richard Robert Rosa Ruth Sabine Samuel Sandra Sarah Sebastian Silvia Sofia Sophie Stefan Stephanie Stephen Susan Susanne Teresa Thomas Ursula Victoria William Wolfgang"
).split()

#: ``{kind:variant}`` is a mention, ``{variant}`` something that is none.
LINES = r"""
Please call {name:full} on {phone} before noon.
Please call {name:cued} on {phone} tomorrow.
You can reach {name:full} at {phone} or {email}.
My number is {phone}, text me any time.
tel {phone}; mail <{email}>
Mobile: {phone}
Fax {phone} is out of order.
They left {phone} as a callback.
She wrote {phone} on the card and left.
We tried {phone} twice.
Telefon: {phone}
Erreichbar unter {phone}.
Bitte unter {phone} melden.
Teléfono de contacto: {phone}.
Llame al {phone} por la tarde.
电话 {phone}。
请致电{phone}联系我们。
ring me on {spoken} ok
my number is {spoken}
call {spoken} and ask for the desk
{name:full} ({phone}) has the key.
Best regards,\n{name:full}\n{phone}
Kind regards,\n{name:initial}\n{phone}
Sincerely,\n{name:full}
Thanks,\n{name:full}\n{email}
Order {plain9} covers {n} items.
Order no. {ssn} was cancelled.
Ticket {ssn} stays open.
Ticket {phone3} is closed.
Invoice {digits} is due.
Roll {ssn} holds the first reel.
Crate {ssn} went to the depot.
Batch {nanp} failed the check.
Lot {nanp} has expired.
Version {dotted} of the tool is out.
This matches build {dotted}.
Release {dotted} fixes it.
Frames {range} are dark.
Pages {range} are missing.
Bitrate moved from {digits} to {digits}.
The counter went from {digits} to {digits} overnight.
The hash begins with {plain10}.
Hash {plain10} and checksum {plain11} differ.
Number on the door: {phone}.
The number on the side was {phone}.
somebody posted a number {id:letters7} in the group
Serial {digits} and part {range} do not match.
Tracking {digits} shows no scan.
Case {digits} was reopened.
Room {n} holds {n} people.
Bestellung {plain9} umfasst {n} Kisten.
Rechnung {digits} ist offen.
Pedido {plain9} salió ayer.
订单 {plain9} 已发货。
The sum was {digits} points in {year}.
Passport no. {id:passport} was shown.
Passport {id:plain9} has expired.
The form shows SSN {id:ssn} next to the stamp.
SSN: {id:plain9}
Social security number {id:ssn} was read aloud.
National insurance {id:nino} and mobile {phone} were given.
National insurance {id:plain9} was on the slip.
The driving licence carries {id:licence}.
The licence held up carries {id:ssn}.
The licence held up carries {id:plain9}.
The license reads {id:dotted}.
Name: {name:cued} | ID: {id:any} | Address: {address}
Name: {name:initial} | ID: {id:any} | Address: {address}
ID number {id:any} is wrong.
Tax id {id:plain9} belongs to them.
Ausweisnummer {id:any} ist zu lesen.
Reisepass {id:passport} liegt vor.
Steuernummer {id:plain11} fehlt.
Se lee el documento {id:any} en la mesa.
DNI {id:dni} caducado.
NIE {id:nie} en trámite.
证件号 {id:any} 可见。
护照 {id:passport} 已过期。
身份证号码{id:plain11}不清楚。
somebody posted a number {id:ssn} in the group
somebody posted a number {id:plain9} in the group
somebody posted a number {id:nino} in the group
they read out {id:ssn} by mistake
there was {id:nino} on the slip
it said {id:nie} at the top
it said {id:dotted} at the top
it said {id:letters7} at the top
Email {email} bounced.
Mail it to {email} please
Write to {email}, thanks.
{email} is no longer used.
Contact: {email}
mailto:{email}
dm {email} for more
You can reach the desk at {email} or {phone}.
The desk can be reached at {email}.
Bitte an {email} antworten.
Escriba a {email} hoy.
举报邮箱为 {email}。
Posted by {handle} at noon.
{handle} pinned the rule; see part@{n}.
Meet us at the gate at noon and look at the sign.
The crowd was at ease at dawn dot by dot.
{name:full} lives at {address} and left.
She lives at {address}.
he lives at {address:lower} i think
we met at {address:lower} last year
She moved the boxes to {address}.
The parcel for {address} came back.
A label reading "{address}" came off.
Statement taken from {name:full}, resident at {address}.
Address: {address}
Deliver to {address} by noon.
{name:full} wohnt in der {address:de}.
Das Paket geht an {name:full}, {address:de}.
Lieferung an {address:de} war spät.
{name:full} vive en {address:es}.
Entrega en {address:es}.
Paquete para {name:full}, {address:es}.
{n} seconds after the street parade it rained.
About {n} people on the street saw it.
After {n} minutes down the road we stopped.
It took {n} hours by the old road to get there.
We counted {n} cars in the street.
It fell {n} metres from the square tower.
{n} frames of the way out are dark.
{n} clips near the court were blocked.
{name:full} signed the form.
{name:full} repeated the complaint.
{name:full} and {name:full}, both present, signed.
{name:initial} and {name:caps}, both present, signed.
{name:caps} signed for it.
{name:cap_family} asked for a copy.
Later {name:full} closed the door.
The file was sent by {name:full} from {email}.
The file was sent by {name:initial} from {email}.
Reporter: {name:cued}; tel {phone}
Witness {name:cued} saw it.
Witness {name:cap_family} saw it.
Escalated by {name:cap_family} ({email}).
Gemeldet von {name:cued}, erreichbar unter {phone}.
Unterschrift: {name:cued}
Firmado: {name:cued}
Avisó {name:full} desde {email}.
After the show {name:full} went home.
Das Paket geht an {name:initial}, {address:de}.
Paquete para {name:initial}, {address:es}.
Avisó {name:initial} desde {email}.
The slip lay next to {name:initial}.
A letter from {name:initial} came.
{name:initial} came later.
that was {name:low} on the left
i saw {name:low} yesterday
{name:low} told me so
talked to {name:low} about it
{name:caps} TOLD ME SO
Herr {name:cued} kam zu spät.
{place} was closed.
The crowd at {place} was calm.
The feed from {place} stopped.
They met near {place} at dusk.
He works outside {place} on Mondays.
The sign in {place} fell.
The crowd at {named_place} was calm.
{named_place} was closed.
See {place}, north of {place}, for the angle.
Am {place} bleibt es ruhig.
En {town} la alarma suena.
Cerca de {place} no hay nadie.
Die Aufnahme aus {town} ist dunkel.
Der Wert an {town} liegt bei {n}.
Die Tafel {town} verdeckt alles.
Die Nachtwache hält ein Licht.
Die Halle {town} ist zu.
Der Kran {town} steht still.
Das Tor {town} klemmt, und Die Brücke {town} auch.
Schild {town} fehlt.
Das Paket aus {town} kam an.
El valor en {town} llega a {n}.
La Camara De {town} falla.
Model Quiet {town} scored {n}.
Version Two Of The {town} plan is out.
The {town} Herald ran a story.
{town} Steel Company closed.
Bank Of {town} opened.
University Of {town} won.
New Year Sale in {town} starts.
THE GUARD FROM {town} LEFT THE PLACE.
AN OLD SIGN AND THE RED CRATE WERE SHOWN.
NIEMAND REAGIERT, ALS DAS TOR AUS {town} FIEL, UND EIN HUND BELLT.
THE CROWD LEFT, AND NO ONE SPOKE, WHILE THE VAN STOOD AT {town}, UNSEEN.
NADIE RESPONDE, CUANDO LA PUERTA CAE EN {town}, Y LLUEVE.
NO ONE AT THE GATE SAW THE RED VAN.
Please Rewind the tape. Batch Review starts on Monday.
See Annex for more. Local Time in {town} was late.
Chat Lines mention a Red Crate.
On Monday Morning we met in {town}.
""".strip().splitlines()  # fmt: skip

_HEADS = "Bar Cal Dor Fen Gar Hol Kin Lan Mor Nor Per Ros Sul Tor Ver Wel Zan".split()
_TAILS = "ba da ga la ma na ra sa ta va".split()
_TOWNS = "berg by dale don field ford gate ham holm mouth ridge stead ton ville wick".split()
_FAMILY = "aro becker dez ek er ez ini man mann ova sen ska son stein ton vic wald well wood y".split()
_WAYS = "Road Street Avenue Lane Close Drive Way Court Place Crescent Rd St Ave".split()
_PLACES = "Market Station Square Park Harbour Bridge Canal Quay Arcade Depot Tunnel Stadium Yard Terrace Pier Campus Mall Museum".split()
_HOSTS = "gmail.com outlook.com web.de gmx.net yahoo.es mail.example.org firm.co.uk uni-town.edu post.io".split()
_DIGITS = "zero one two three four five six seven eight nine".split()
_ZIFFERN = "null eins zwei drei vier fünf sechs sieben acht neun".split()
_CIFRAS = "cero uno dos tres cuatro cinco seis siete ocho nueve".split()


class _Filler:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def d(self, n: int, first: str = "0123456789") -> str:
        return self.r.choice(first) + "".join(self.r.choice("0123456789") for _ in range(n - 1))

    def stem(self) -> str:
        return self.r.choice(_HEADS) + "".join(self.r.choice(_TAILS) for _ in range(self.r.randint(0, 1)))

    def town(self) -> str:
        return self.stem() + self.r.choice(_TOWNS)

    def family(self) -> str:
        f = self.stem() + self.r.choice(_FAMILY)
        return f"{f}-{self.stem()}{self.r.choice(_FAMILY)}" if self.r.random() < 0.06 else f

    def given(self, made_up: float = 0.0) -> str:
        return self.stem() if self.r.random() < made_up else self.r.choice(GIVEN)

    def name(self, how: str) -> str:
        r = self.r
        mid = f" {r.choice('ABCDEFGHJKLMPRST')}." if r.random() < 0.12 else ""
        if how in ("cued", "full") and r.random() < 0.12:
            how = "initial"
        if how == "cued":
            return f"{self.given(0.3)}{mid} {self.family()}"
        if how == "initial":
            return f"{r.choice('ABCDEFGHJKLMPRST')}. {self.family()}"
        if how == "caps":
            return f"{self.given()}{mid} {self.family()}".upper()
        if how == "cap_family":
            return f"{self.family().upper()}, {self.given()}"
        if how == "low":
            return f"{self.given()} {self.family()}".lower()
        return f"{self.given()}{mid} {self.family()}"

    def ssn(self) -> str:
        return self.r.choice("- ").join((self.d(3), self.d(2), self.d(4)))

    def phone(self) -> str:
        r, d = self.r, self.d
        s = r.choice((" ", "-", ".", " "))
        ext = f" ext. {d(2)}" if r.random() < 0.06 else ""
        return r.choice(
            (
                lambda: f"{d(3, '23456789')}{s}{d(3, '23456789')}{s}{d(4)}{ext}",
                lambda: f"({d(3, '23456789')}) {d(3, '23456789')}-{d(4)}{ext}",
                lambda: f"+1 {d(3, '23456789')} {d(3, '23456789')} {d(4)}",
                lambda: f"+1{d(3, '23456789')}{d(7, '23456789')}",
                lambda: f"1-{d(3, '23456789')}-{d(3, '23456789')}-{d(4)}{ext}",
                lambda: f"{d(3, '23456789')}-{d(4)}",
                lambda: f"020 {d(4, '378')} {d(4)}",
                lambda: f"+44 (0)20 {d(4, '378')} {d(4)}",
                lambda: f"+44 20 {d(4, '378')} {d(4)}",
                lambda: f"07{d(3)} {d(6)}",
                lambda: f"+44 7{d(3)} {d(6)}",
                lambda: f"+44 7{d(3)} {d(3)} {d(3)}",
                lambda: f"0{d(3, '1')} {d(3)} {d(4)}",
                lambda: f"0{d(2, '34568')} {d(5)}{r.choice((' ', '-'))}{d(3)}",
                lambda: f"0{d(3, '1234567')}/{d(6)}",
                lambda: f"+49 {d(2, '34568')} {d(5)}{r.choice((' ', '-'))}{d(3)}",
                lambda: f"0049{r.choice((' ', '-', '‑'))}{d(5)}{r.choice((' ', '-', '‑'))}{d(3)}",
                lambda: " ".join((f"0{d(1, '12345')}", d(2), d(2), d(2), d(2))),
                lambda: " ".join(("+33", d(1, "12345"), d(2), d(2), d(2), d(2))),
                lambda: f"+34 {d(3, '69')} {d(3)} {d(3)}",
                lambda: f"+{d(2, '3456789')} {d(3)} {d(3)} {d(3)}",
            )
        )()

    def id(self, how: str) -> str:
        d, r = self.d, self.r
        letter = lambda: r.choice("ABCDEFGHJKLMPRSTWXYZ")
        if how == "any":
            how = r.choice(("ssn", "ssn", "nino", "nino", "plain9", "passport", "dni", "nie", "dotted", "letters7"))
        if how == "ssn":
            return self.ssn()
        if how == "nino":
            s = r.choice(("", " "))
            return letter() + letter() + s + s.join((d(2), d(2), d(2))) + s + r.choice("ABCD")
        if how == "dni":
            return d(8) + r.choice(("", "-")) + letter()
        if how == "nie":
            return r.choice("XYZ") + "-" + d(7) + "-" + letter()
        if how == "dotted":
            return f"{d(3)}.{d(3)}.{d(3)}-{letter()}"
        if how == "licence":
            return r.choice((self.id("nie"), self.id("letters7"), self.id("nino")))
        if how == "letters7":
            return letter() + letter() + d(7)
        if how == "passport":
            return r.choice((letter() + d(8), letter() + letter() + d(7), self.ssn(), d(9)))
        return d(11 if how == "plain11" else 9)

    def email(self) -> str:
        r = self.r
        local = r.choice((f"{r.choice(GIVEN)}{r.choice('._-')}{self.family()}", f"{r.choice('abcdejkmo')}{self.d(3)}", f"{self.stem()}{self.d(2)}", f"{r.choice(GIVEN)}.{self.family()}+news", f"info.{self.town()}")).lower()
        host = r.choice((*_HOSTS, f"{self.town()}.com".lower(), f"mail.{self.town()}.net".lower(), f"{self.town()}-{self.stem()}.org".lower()))
        k = r.random()
        if k < 0.6:
            m = f"{local}@{host}"
            return m.upper() if r.random() < 0.08 else m
        dots = host.replace(".", r.choice((" dot ", "(dot)", " [dot] ", " . ")))
        if k < 0.7:
            return f"{local} @ {host.replace('.', ' . ')}"
        if k < 0.75:
            return f"{local}＠{host}"
        if k < 0.85:
            return f"{local.replace('.', ' dot ')} at {host.replace('.', ' dot ')}"
        if k < 0.9:
            return f"{local} AT {host.replace('.', ' DOT ')}"
        return f"{local}{r.choice(('(at)', ' [at] ', '{at}'))}{dots if r.random() < 0.5 else host}"

    def address(self, how: str) -> str:
        r = self.r
        n = r.choice((self.d(2, "123456789"), self.d(3, "123"), self.d(2, "123456789") + r.choice("ABC"), f"{self.d(2, '1234')}-{self.d(2, '56789')}"))
        if how == "de":
            street = self.stem() + r.choice(("straße", "strasse", "weg", "allee", "gasse", "platz"))
            return f"{street} {r.randint(1, 200)}{r.choice(('', 'a', 'c'))}{r.choice(('', f', {self.d(5)} {self.town()}', f' in {self.town()}'))}"
        if how == "es":
            return f"{r.choice(('Calle', 'Avda.', 'Plaza de', 'Paseo de'))} {self.town()}{r.choice((', ', ' n.º '))}{r.randint(1, 200)}{r.choice(('', f', {self.d(5)} {self.town()}'))}"
        unit = r.choice(("", "", f", Flat {r.randint(1, 40)}", f" #{r.randint(1, 99)}", f", Apt {r.randint(1, 40)}"))
        end = r.choice(("", "", f", {self.town()}", f", {self.town()} {self.d(5)}", f", {self.town()}, ZQ{r.randint(1, 19)} {r.randint(1, 9)}XX"))
        a = f"{n} {self.town()} {r.choice(_WAYS)}{unit}{end}"
        return a.lower() if how == "lower" else a

    def mention(self, kind: str, how: str) -> str:
        if kind == "name":
            return self.name(how)
        if kind == "phone":
            return self.phone()
        if kind == "id":
            return self.id(how or "any")
        return self.email() if kind == "email" else self.address(how)

    def other(self, what: str) -> str:
        r, d = self.r, self.d
        if what == "spoken":
            words = r.choice((_DIGITS, _ZIFFERN, _CIFRAS))
            return " ".join(r.choice(words) for _ in range(r.choice((7, 8, 10))))
        return {
            "plain9": lambda: d(9, "123456789"),
            "plain10": lambda: d(10, "123456789"),
            "plain11": lambda: d(11, "123456789"),
            "digits": lambda: d(r.randint(6, 8), "123456789"),
            "ssn": self.ssn,
            "nanp": lambda: " ".join((d(3), d(3), d(4))),
            "phone3": lambda: f"{d(2)}-{d(2)}-{d(4)}",
            "dotted": lambda: f"{r.randint(1, 99)}.{d(r.choice((2, 3)), '123456789')}.{d(4, '123456789')}",
            "range": lambda: f"{d(4, '123456789')}-{d(4, '123456789')}",
            "n": lambda: str(r.randint(2, 400)),
            "year": lambda: str(r.randint(1990, 2026)),
            "handle": lambda: "@" + self.stem().lower() + d(2),
            "town": self.town,
            "named_place": lambda: f"{r.choice(GIVEN)} {r.choice(_PLACES + _WAYS)}",
            "place": lambda: f"{self.town()} {r.choice(_PLACES)}",
        }[what]()


_SLOT = re.compile(r"\{(\w+)(?::(\w+))?\}")
_KINDS = {"name": "name", "phone": "phone", "id": "id_number", "email": "email", "address": "address"}


def rows(times: int = 24, seed: int = 1) -> list[tuple[str, list[tuple[str, int]]]]:
    """Texts with their mentions (kind, start): every line ``times`` times, three lines to a text in random order, in several styles."""
    f = _Filler(seed)
    lines = [line.replace("\\n", "\n") for line in LINES for _ in range(times)]
    f.r.shuffle(lines)
    out = []
    for k in range(0, len(lines), 3):
        text, marks = "", []
        lead = f.r.choice(("", "", "- ", f"[{f.r.randint(10, 23)}:{f.r.randint(10, 59)}] ", f"{f.stem().lower()}{f.d(2)}: "))
        for line in lines[k : k + 3]:
            text += lead
            last = 0
            for m in _SLOT.finditer(line):
                text += line[last : m.start()]
                last = m.end()
                if m[1] in _KINDS:
                    marks.append((_KINDS[m[1]], len(text)))
                    text += f.mention(m[1], m[2] or "")
                else:
                    if m[1] == "spoken":
                        marks.append(("phone", len(text)))
                    text += f.other(m[1])
            text += line[last:] + f.r.choice((" ", "\n", "  "))
        out.append((text, marks))
    return out
