"""Invented items and sentences that vary what the tagger sees in training.

The items of the labelled sample come from few syllables and number ranges, and
a model trained on them alone learns these.  Here items are put together by
public formats from random letters, syllables and digits, and take the place of
labelled ones or stand in sentences of their own.  Nothing here takes part in
finding items.
"""

from __future__ import annotations

import numpy as np

# Common words of public formats, and frames in which items stand.
GIVEN = (
    "Anna Maria Peter Thomas Laura James Robert Linda Karen Paul Mark Lisa Sarah David Daniel Emma Oliver Sophie Julia Lukas Felix Clara Jonas Marie Nina Carlos Miguel "
    "Lucia Pierre Claire Marco Giulia Ahmed Fatima Yuki Wei Priya Arjun Olga Elena Dmitri Sergei Kofi Amara Ingrid Lars Björn Zoë René José Agnieszka Piotr Mehmet Ayşe"
).split()
FAMILY = (
    "Miller Johnson Brown Taylor Wilson Clark Lewis Walker Young King Wright Baker Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder "
    "Dubois Moreau Laurent Rossi Bianchi Romano Garcia Martinez Lopez Silva Santos Nguyen Tanaka Kim Chen Wang Singh Patel Khan Okafor Mensah Jensen Nielsen Larsson Kowalski Novák Yılmaz"
).split()
RU_GIVEN = "Анна Мария Ольга Елена Наталья Сергей Дмитрий Алексей Андрей Павел Николай Михаил Татьяна Юлия Виктор Егор".split()
RU_FAMILY = "Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков Зайцев Павлов Семёнов Голубев Виноградов Белый".split()
PARTICLES = ("van", "von", "de", "der", "di", "la", "van der", "von der", "de la")
STREETS = (
    ("Street", "St", "St."), ("Avenue", "Ave", "Ave."), ("Road", "Rd", "Rd."), ("Lane", "Ln"), ("Drive", "Dr"), ("Court", "Ct"), ("Boulevard", "Blvd"), ("Way",), ("Place", "Pl"), ("Terrace",), ("Square", "Sq"), ("Close",), ("Crescent",), ("Parkway",),
)
DE_STREETS = ("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "ring", "damm", "ufer")
TOWNS = ("London", "Leeds", "Boston", "Austin", "Berlin", "Hamburg", "Köln", "Wien", "Москва", "Казань", "Springfield", "Oxford", "Denver", "Bristol", "Portland", "Graz")
DOMAINS = ("com", "org", "net", "de", "ru", "co.uk", "io", "eu", "edu", "example", "test", "fr", "at", "ch")
MAKERS = ("mail", "post", "corp", "office", "web", "lab", "team", "data", "soft", "works", "group", "north", "blue", "river", "stone", "cloud")
FRAMES = {
    "name": (
        "Please ask {name} about the rollout.", "{name} signed off on this.", "cc {name}", "Best regards,\n{name}", "Spoke to {name} on Monday.", "Mr. {name} will join.", "Mrs {name} called twice.", "Dr. {name} wrote the report.",
        "Assigned to {name}, due Friday.", "The author is {name}.", "Thanks, {name}!", "{name}'s review is pending.", "Reviewed-by: {name}", "contact: {name}", "Met {name} and {name} at the office.", "owner={name};", "It was {name} who found it.",
        "Frau {name} hat zugestimmt.", "Bitte {name} fragen.", "Herr {name} kommt morgen.", "Gruß, {name}", "Спросите {name} об этом.", "Позвонила {name}.", "Автор: {name}", "{name} согласовал план.", "According to {name}, it is fine.", "- {name}: will check", "Hi {name},",
        "{name} moved to another team.", "invoice for {name}, see below", "Patient {name} was told.", "signed by {name} yesterday", "the lawyer, {name}, agreed", "Yesterday {name} fixed the build.", "Our new colleague {name} starts today.", "{name} and {name} disagree.", "отправил {name} вчера", "Ansprechpartner ist {name}.",
    ),
    "phone": (
        "Call {phone} after six.", "Phone: {phone}", "My number is {phone}.", "tel. {phone}", "Reach me at {phone} or by mail.", "mobile={phone};", "Fax {phone}, ext. 12", "Telefon {phone}", "Звоните по телефону {phone}.", "Rückruf unter {phone} bitte.",
        "text {phone} when done", "hotline {phone}", "({phone})", "тел.: {phone}", "WhatsApp {phone}", "ring {phone} x204", "dial {phone} to join", "on-call phone {phone} is dead", "Mobil: {phone}", "моб. {phone}, спросить Олю",
    ),
    "id_number": (
        "SSN {ssn}", "Social security number: {ssn}", "her SSN is {ssn}.", "the social security number {ssn} was in the log", "NI number {nino}", "National Insurance number: {nino}", "insurance no. {nino}", "passport no. {pass}", "Passport number {pass} expires soon.", "passport: {pass}", "Reisepass {pass}",
        "id card {card}", "Personalausweis {card}", "Ausweis Nr. {card}", "tax id {tax}", "Steuer-ID {tax}", "Steuernummer: {tax}", "taxpayer id {tax}", "ИНН {inn}", "СНИЛС {snils}", "паспорт {rupass}", "Паспорт: {rupass}, выдан в 2014", "ssn={ssn};", "identity card number {card}", "her tax number is {tax}", "паспорт серии {rupass}",
        "TIN: {tax}", "holder of passport {pass}", "ID card no. {card}, valid", "social security no. {ssn}", "Ausweisnummer {card}", "Sozialversicherungsnummer {tax}", "номер паспорта {rupass}",
    ),
    "address": (
        "Lives at {address}.", "Send it to {address}, {town}.", "Address: {address}, {town}", "Ship to {address}, {town} 10115", "the office at {address} is closed", "Meet at {address}, {town}!", "deliver={address};", "{address}\n{town}", "Wohnt in der {de_address}, {town}.", "Adresse: {de_address}, 10115 {town}", "Bitte an {de_address} liefern.",
        "Адрес: {ru_address}, {town}", "Живёт по адресу {ru_address}.", "доставить на {ru_address}, г. {town}", "moved from {address} to {address} in May", "billing address {address}", "parcel for {address}, {town}, was lost", "we are located at {address}", "Büro: {de_address}", "{de_address}, {town}", "The van stops at {address} each day.",
    ),
    "email": (
        "Write to {email} please.", "email: {email}", "cc {email}, thanks", "<{email}>", "Contact {email} for access.", "mailto:{email}", "{email} bounced", "Mail an {email} schicken.", "Пишите на {email}.", "user={email};", "From: {email}", "ask {email} or {email}", "sent by {email} at noon",
    ),
    "none": (
        "We visited New York last spring.", "Open the Pull Request and wait.", "Apache Spark and Visual Studio Code are installed.", "Release Candidate {n} ships on Friday.", "Build {n}-{n} took {n} ms.", "Ticket ABC-{n} is closed.", "Version 10.{n}.3 of the parser.", "See RFC {n} for details.", "Commit 4f{n}ab9 broke main.",
        "The Northern Line was late.", "Kubernetes Cluster North is down.", "At 12:{m} on 2024-05-{m} it failed.", "IP 10.0.{m}.7 port {n}", "total: {n}.{m} EUR", "Redis Sentinel restarted {m} times.", "chapter {m}, page {n}", "Great Britain and South Korea agreed.", "Ein Pull Request ist offen.", "Das Rote Kreuz half.", "Order {n}{n} was shipped.",
        "Большой Театр открыт.", "заказ {n}{n} оплачен", "Deutsche Bahn hat Verspätung.", "{n} rows in {m} shards", "{m} Days Later was shown.", "Room {n} is free.", "The Main Street project is late.", "checksum {n}{n}{n}", "uuid 8c{n}-{n}", "United Nations report {n}", "Monday Morning Meeting", "Data Lake House Team", "{n} files changed, {m} insertions", "HTTP {n} from Service Mesh",
        "key {n}-{n}-{n}", "range {n} - {n}", "ratio {m}:{m}", "serial no. {n}{n}", "invoice {n}/{m}", "about {n} {m} {n} bytes", "pi is 3.14159{n}", "in 20{m} the Red Sea Road opened", "Queue Worker and Snapshot Builder", "npm i @scope/pkg@{m}.0.1", "git@host.example:team/repo.git", "https://user@host.example/x",
    ),
}

_ONSET = ("b", "br", "c", "ch", "d", "dr", "f", "g", "gr", "h", "j", "k", "kl", "l", "m", "n", "p", "r", "s", "sch", "sh", "st", "t", "th", "tr", "v", "w", "z", "")
_VOWEL = ("a", "e", "i", "o", "u", "ai", "ei", "ia", "ou", "y", "ö", "ä", "é", "ü", "á")
_END = ("n", "r", "s", "l", "t", "m", "ck", "nd", "rt", "ski", "sen", "son", "man", "er", "a", "o", "", "", "ez", "ini", "berg", "feld")
_RU_ONSET = tuple("бвгджзклмнпрстфхчш") + ("ст", "кр", "")
_RU_VOWEL = tuple("аеиоуыюя")
_RU_END = ("ов", "ев", "ин", "ский", "ко", "н", "р", "л", "й", "ова", "ина", "а", "я", "ич")


class Shapes:
    """Random items; every method gives a new one."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng

    def one(self, of):
        return of[int(self.rng.integers(len(of)))]

    def odds(self, p: float) -> bool:
        return self.rng.random() < p

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self, russian: bool = False) -> str:
        onset, vowel, end = (_RU_ONSET, _RU_VOWEL, _RU_END) if russian else (_ONSET, _VOWEL, _END)
        few = 5 if not russian and not self.odds(0.15) else len(vowel)
        return ("".join(self.one(onset) + self.one(vowel[:few]) for _ in range(int(self.rng.integers(1, 3)))) + self.one(end)).capitalize()

    def name(self) -> str:
        russian = self.odds(0.2)
        given = self.one(RU_GIVEN if russian else GIVEN) if self.odds(0.4) else self.word(russian)
        family = self.one(RU_FAMILY if russian else FAMILY) if self.odds(0.4) else self.word(russian)
        if russian and self.odds(0.3) and family.endswith(("ов", "ев", "ин")):
            family += "а"
        if not russian:
            family = self.one(("Mc", "O'", "Mac")) + family if self.odds(0.04) else family
            family = f"{family}-{self.one(FAMILY)}" if self.odds(0.06) else family
            given = f"{given}-{self.one(GIVEN)}" if self.odds(0.04) else given
        dice = self.rng.random()
        if dice < 0.6:
            out = f"{given} {family}"
        elif dice < 0.7:
            out = f"{given} {self.one('ABCDEFGHJKLMNPRSTW')}. {family}" if not russian else f"{given} {self.word(True)} {family}"
        elif dice < 0.78 and not russian:
            out = f"{given} {self.one(PARTICLES)} {family}"
        elif dice < 0.88:
            out = f"{given[0]}. {family}"
        else:
            out = f"{family}, {given}"
        return out.upper() if self.odds(0.08) else out.lower() if self.odds(0.06) else out

    def phone(self) -> str:
        d, sep = self.digits, self.one((" ", "-", " ", ".", ""))
        dice = int(self.rng.integers(9))
        if dice == 0:
            return f"+{self.one(('44', '49', '33', '7', '43', '41', '39', '34', '48', '91', '81'))} {d(self.one((2, 3, 4)))} {d(self.one((3, 4, 6, 7)))}" + (f"{sep}{d(2)}" if self.odds(0.3) else "")
        if dice == 1:
            return f"+1{self.one((' ', '-', '.'))}{d(3)}{sep or ' '}{d(3)}{sep or ' '}{d(4)}"
        if dice == 2:
            return f"({d(3)}) {d(3)}-{d(4)}"
        if dice == 3:
            return f"+7 ({d(3)}) {d(3)}-{d(2)}-{d(2)}" if self.odds(0.5) else f"8 {d(3)} {d(3)}-{d(2)}-{d(2)}"
        if dice == 4:
            return f"0{d(self.one((2, 3, 4)))}{self.one((' ', '/', '-', ' / '))}{d(self.one((6, 7, 8)))}"
        if dice == 5:
            return f"0{d(3)} {d(3)} {d(4)}"
        if dice == 6:
            return f"00{self.one(('49', '44', '7', '33'))}{sep}{d(3)}{sep}{d(3)}{sep}{d(4)}"
        if dice == 7:
            return f"+{self.one(('44', '49', '7', '1', '33'))}{d(self.one((9, 10)))}"
        return f"+{self.one(('44', '49', '33'))} (0){d(3)} {d(3)} {d(3)}"

    def id_part(self, kind: str) -> str:
        d = self.digits
        letters = "ABCEGHJKLMNPRSTWXYZ"
        if kind == "ssn":
            return f"{d(3)}-{d(2)}-{d(4)}" if self.odds(0.8) else f"{d(3)} {d(2)} {d(4)}"
        if kind == "nino":
            gap = self.one((" ", ""))
            return f"{self.one(letters)}{self.one(letters)}{gap}{d(2)}{gap}{d(2)}{gap}{d(2)}{gap}{self.one('ABCD')}"
        if kind == "pass":
            return self.one(("", self.one(letters), self.one(letters) + self.one(letters), self.one(letters) + "-")) + d(self.one((7, 8, 9)))
        if kind == "card":
            return self.one(("", "L", "T", self.one(letters))) + d(self.one((8, 9))) + (f" {self.one('ABCD')}" if self.odds(0.05) else "")
        if kind == "tax":
            return self.one((d(11), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)}-{d(7)}", d(10)))
        if kind == "inn":
            return d(self.one((10, 12)))
        if kind == "snils":
            return f"{d(3)}-{d(3)}-{d(3)} {d(2)}"
        return f"{d(4)} {d(6)}" if self.odds(0.7) else f"{d(2)} {d(2)} {d(6)}"

    def address(self) -> str:
        kind = self.one(self.one(STREETS))
        street = " ".join(self.word() if self.odds(0.6) else self.one(FAMILY + ["High", "Church", "Park", "Oak", "Mill", "North", "Station", "Queen", "River", "Elm", "Maple"]) for _ in range(1 + self.odds(0.15)))
        street = f"{self.one(('North', 'West', 'S.', 'E.', 'St.'))} {street}" if self.odds(0.08) else street
        out = f"{self.rng.integers(1, 2000)}{self.one('abc') if self.odds(0.08) else ''} {street} {kind}"
        if self.odds(0.12):
            out = f"{self.one(('Flat', 'Unit', 'Apt', 'Suite', 'Apartment'))} {self.rng.integers(1, 90)}{self.one('ABC') if self.odds(0.2) else ''}, {out}"
        elif self.odds(0.15):
            out += self.one((", ", " ")) + self.one((f"Apt {self.rng.integers(1, 99)}", f"#{self.rng.integers(1, 99)}", f"Suite {self.rng.integers(1, 900)}", f"Unit {self.rng.integers(1, 20)}B", f"Apt. {self.rng.integers(1, 20)}"))
        return out.lower() if self.odds(0.04) else out.upper() if self.odds(0.03) else out

    def de_address(self) -> str:
        kind = self.one(DE_STREETS)
        stem = self.word() if self.odds(0.6) else self.one(("Haupt", "Bahnhof", "Schul", "Garten", "Linden", "Berg", "Kirch", "Goethe", "Schiller", "Wald"))
        street = f"{stem} {kind.capitalize()}" if self.odds(0.1) else stem + kind
        return f"{street} {self.rng.integers(1, 300)}{self.one('abcd') if self.odds(0.2) else ''}"

    def ru_address(self) -> str:
        word = self.word(True) if self.odds(0.5) else self.one(("Ленина", "Садовая", "Мира", "Гагарина", "Лесная", "Победы", "Школьная"))
        n = f"{self.rng.integers(1, 200)}{self.one('абв') if self.odds(0.1) else ''}"
        flat = f", кв. {self.rng.integers(1, 300)}" if self.odds(0.4) else ""
        dice = self.rng.random()
        if dice < 0.5:
            return f"{self.one(('ул.', 'улица', 'пр.', 'проспект', 'пер.'))} {word}, {self.one(('д. ', 'дом ', ''))}{n}{flat}"
        return f"{word} {self.one(('улица', 'площадь', 'набережная'))}, {self.one(('д. ', 'дом '))}{n}{flat}"

    def email(self) -> str:
        user = self.one((self.word().lower(), f"{self.word()}.{self.word()}".lower(), f"{self.one('abcdefgh')}.{self.one(FAMILY)}".lower(), f"{self.one(GIVEN)}{self.digits(2)}".lower(), f"{self.word()}_{self.word()}", f"{self.word()}+{self.one(MAKERS)}".lower(), "info", "sales-team"))
        host = self.one(MAKERS) + (self.one(("-", "")) + self.word().lower() if self.odds(0.5) else "")
        host, end = (f"{self.one(MAKERS)}.{host}" if self.odds(0.2) else host), self.one(DOMAINS)
        dice = self.rng.random()
        if dice < 0.85:
            out = f"{user}@{host}.{end}"
        elif dice < 0.9:
            out = f"{user} at {host} dot {end.replace('.', ' dot ')}"
        elif dice < 0.95:
            out = f"{user} [at] {host} [dot] {end.replace('.', ' [dot] ')}"
        else:
            out = f"{user}(at){host}.{end}"
        return out.upper() if self.odds(0.06) else out

    def item(self, kind: str) -> str:
        if kind == "address":
            return self.one((self.address, self.address, self.de_address, self.ru_address))()
        return {"name": self.name, "phone": self.phone, "email": self.email}[kind]()

    def sentence(self, kind: str | None = None) -> tuple[str, list[tuple[str, int, int]]]:
        """A sentence and its items."""
        kind = kind or self.one(("name", "name", "phone", "id_number", "address", "email", "none", "none"))
        frame, out, items = self.one(FRAMES[kind]), "", []
        while "{" in frame:
            head, _, rest = frame.partition("{")
            slot, _, frame = rest.partition("}")
            out += head
            if slot == "n":
                part, is_item = str(self.rng.integers(100, 10**int(self.rng.integers(3, 7)))), False
            elif slot == "m":
                part, is_item = str(self.rng.integers(10, 60)), False
            elif slot == "town":
                part, is_item = self.one(TOWNS), False
            elif kind == "id_number":
                part, is_item = self.id_part(slot), True
            else:
                part, is_item = getattr(self, slot)(), True
            if is_item:
                items.append((kind, len(out), len(out) + len(part)))
            out += part
        out += frame
        return out, items

    def rewritten(self, text: str, items: list[tuple[str, int, int]], share: float = 0.6) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with some items replaced by new ones of their type and some sentences put in."""
        out, found, at = [], [], 0
        size = 0

        def add(part: str) -> None:
            nonlocal size
            out.append(part)
            size += len(part)

        def put(after: str) -> None:
            """An item among words that don't announce it."""
            kind = self.one(("name", "name", "address", "email", "phone"))
            new = self.item(kind)
            found.append((kind, size, size + len(new)))
            add(new + after)

        for kind, a, b in items:
            between = text[at:a]
            if (blank := between.find(" ", int(self.rng.integers(0, max(1, len(between)))))) >= 0 and self.odds(0.25):
                add(between[: blank + 1])
                put(" ")
                between = between[blank + 1 :]
            add(between)
            old = text[a:b]
            new = self.item(kind) if kind != "id_number" and self.odds(share) else "".join(self.digits(1) if c.isdigit() else c for c in old) if kind == "id_number" and self.odds(share) else old
            found.append((kind, size, size + len(new)))
            add(new)
            at = b
            if self.odds(0.1) and text[b : b + 1] in (".", "\n") and text[b : b + 2] in (". ", ".\n", "\n", ".", ".."):
                add(text[b : b + 1] + " ")
                at = b + 1
                said, inside = self.sentence()
                found += [(k, size + x, size + y) for k, x, y in inside]
                add(said)
        rest = text[at:]
        if (blank := rest.find(" ", int(self.rng.integers(0, max(1, len(rest)))))) >= 0 and self.odds(0.5):
            add(rest[: blank + 1])
            put("")
            rest = rest[blank:]
        add(rest)
        if self.odds(0.5) or not items:
            for _ in range(int(self.rng.integers(1, 4))):
                add(self.one(("\n", " ", "\n\n")))
                said, inside = self.sentence()
                found += [(k, size + x, size + y) for k, x, y in inside]
                add(said)
        return "".join(out), found
