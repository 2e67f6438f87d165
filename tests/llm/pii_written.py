"""A hundred sentences written by hand; each item is marked as [type|item].  Not used in training."""

WRITTEN = """
I met [name|Hannah Fitzgerald] outside the theatre.
[name|John Smith] owes me a coffee.
The keynote was given by [name|Margaret Hamilton] in spring.
Вчера приходил [name|Иван Петров] и всё проверил.
Dear Mr [name|Desmond Achebe], your order has shipped.
Ms. [name|Katherine O'Leary] will take the minutes.
Bitte wende dich an [name|Stefan Krüger] im zweiten Stock.
Prof. [name|Leila Haddad]'s lecture starts at nine.
The form was filled in by [name|T. Abernathy] last week.
Kind regards,\n[name|Veronica Sandoval]
We hired [name|Jean-Luc Beaumont] as an architect.
approved-by: [name|Harriet Blackwood]
[name|Ludwig van Houten] and [name|Grace Whitfield] share a desk.
Звонила [name|Светлана Орлова], просила перезвонить.
Guests: [name|Nakamura, Haruto]; others follow.
Did [name|Patrick J. Donnelly] sign the lease?
the nurse, [name|Beatrice Lindqvist], wrote it down
cc [name|Oscar Wrzesniewski], please review
Frau [name|Elfriede Baumgartner] ist im Urlaub.
[name|Tobias Engström] broke the build again.
Reach the desk on [phone|+44 20 7946 0958] during the day.
Call [phone|(415) 555-0132] and leave a message.
Tel: [phone|030 12345678]
My mobile is [phone|07700 900123], any time.
Мой телефон [phone|+7 495 123-45-67], звоните.
Fax us at [phone|+1-212-555-0187] today.
Rufnummer: [phone|+49 89 636 48018]
phone=[phone|+33 1 42 68 53 00];
The hotline ([phone|0800 123 4567]) is free.
Text [phone|+14155550199] to opt out.
ring [phone|0161 496 0345] ext. 7
Дежурный: [phone|8 800 555-35-35]
Handy [phone|0171/2345678]
For support dial [phone|1-800-555-0142].
Our office: [phone|+61 2 5550 4321], ask for Kim.
contact number [phone|+353 1 555 0123]
[phone|+48 22 555 01 23] is the reception
Bitte zurückrufen: [phone|0049 30 5550123]
Emergency: [phone|+91 98765 43210]
You can also use [phone|01632 960 555].
His SSN is [id_number|078-05-1120].
Social Security Number: [id_number|219-09-9999]
NI number [id_number|QQ 12 34 56 C]
National insurance number is [id_number|AB123456D].
Passport no. [id_number|123456789]
passport number: [id_number|C01X00T47]
Travelled on passport [id_number|K1234567] in June.
Steuer-ID: [id_number|86 095 742 719]
Meine Steuernummer lautet [id_number|21/815/08150].
Personalausweis [id_number|L01234567]
ИНН [id_number|7707083893]
СНИЛС: [id_number|112-233-445 95]
паспорт [id_number|4510 123456] выдан в Москве
tax id [id_number|12-3456789]
ID card number [id_number|987654321]
the taxpayer id is [id_number|944-72-1234]
insurance number [id_number|JK 44 55 66 A]
ssn=[id_number|457-55-5462]
Reisepass [id_number|C4F7K21PZ]
Паспорт [id_number|40 08 654321]
She lives at [address|221 Baker Street], London.
Ship it to [address|1600 Pennsylvania Avenue], Washington.
Send mail to [address|742 Evergreen Terrace], Springfield.
Our shop: [address|12 Grimmauld Place]
Die Adresse ist [address|Lindenallee 17], Potsdam.
Wir sitzen in der [address|Friedrichstraße 123].
Живу по адресу [address|ул. Тверская, д. 7, кв. 12].
Адрес склада: [address|проспект Вернадского, 45]
Visit [address|350 Fifth Avenue, Suite 3300] on Monday.
Return to [address|Flat 4, 18 Chestnut Grove Road], Leeds.
Office at [address|88 Colin P Kelly Jr St] in the city
billing: [address|9 Willow Lane], Bath BA1
Bitte an [address|Mozartgasse 4b] liefern.
Meet me at [address|500 Terry Francois Blvd] tomorrow.
the depot on [address|27 Harbour Drive] is flooded
Lieferung: [address|Kastanienweg 8], 50667 Köln
address=[address|31 Spooner Street];
Move-in at [address|1428 Elm St, Apt 6] in July.
He left it at [address|10 Downing Street].
Доставка: [address|улица Пушкина, дом 10]
Mail [email|jane.doe@example.org] for the slides.
[email|support@acme-tools.io] never answers
Write to [email|k.o'neil2@students.uni.edu] soon.
Kontakt: [email|max_muster@firma.de]
Почта: [email|ivan.petrov@yandex.ru]
<[email|no-reply@mailer.shop.co.uk>]
send to [email|bob (at) example (dot) com] please
use [email|alice at wonder dot org] instead
CC: [email|SALES@BIGCORP.COM], thanks
cc [email|first.last+tag@sub.domain.net]
Report to [email|abuse@isp.example]!
user [email|r2d2@droids.space] was locked
Fragen an [email|buchhaltung@bäckerei-huber.de].
email=[email|x@y.co];
the list [email|dev-owner@lists.project.org] moved
forwarded by [email|tom.sawyer@river.us] yesterday
login [email|mary99@inbox.test] failed
[email|hr@company.fr] et [email|it@company.fr]
Ask [email|helpdesk[at]campus[dot]edu] first.
Rückfragen: [email|service@stadtwerke.at]
""".replace("@mailer.shop.co.uk>]", "@mailer.shop.co.uk]>").strip().split("\n")


def parsed(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text of a line and its items."""
    out, items = "", []
    for part in line.replace("\\n", "\n").replace("[at]", "\0").replace("[dot]", "\1").split("["):
        kind, bar, rest = part.partition("|")
        if bar and kind in ("name", "phone", "id_number", "address", "email"):
            item, _, after = rest.partition("]")
            items.append((kind, item, len(out)))
            out += item + after
        else:
            out += part
    found = []
    for kind, item, at in items:
        grown = out[:at].replace("\0", "[at]").replace("\1", "[dot]")
        item = item.replace("\0", "[at]").replace("\1", "[dot]")
        found.append((kind, len(grown), len(grown) + len(item)))
    return out.replace("\0", "[at]").replace("\1", "[dot]"), found
