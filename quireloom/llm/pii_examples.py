"""The small labelled table from which the tagger of personal details is trained.

Each template is a labelled text: {name}, {phone}, {email}, {id} and {addr} are
details of that kind, everything else is none. The templates are written for
this purpose, from many kinds of texts; slots are filled with invented values of
the usual forms, by a fixed seed. For the training some of their words are
exchanged at random, and as many lines are details and other items among random
words, so that no wording is learnt by heart. Every HELD-th template is kept out
of the training and only used to measure.
"""

from __future__ import annotations

import random
import re

KINDS = ["email", "phone", "id_number", "address", "name"]
_SLOT_KIND = {"email": "email", "phone": "phone", "id": "id_number", "addr": "address", "name": "name", "plain": "name"}
HELD, UNLISTED = 6, 0.05

# Texts of the labelled table, a line each; \n joins lines of one text.
WITH_DETAILS = r"""
{name}
{phone}
{email}
{addr}
{name}
{phone}
{email}
{addr}
{name} {phone}
{name} {email}
{name}, {phone}, {email}
{name}, {email}, {phone}
{name}; {phone}
{name} | {phone}
{name} | {email}
{name} / {email}
{name} / {phone}
{name} - {phone}
{name} – {email}
{name}: {phone}
{name} ({email})
{name} ({phone})
{name} <{email}>
{name} [{phone}]
<{email}>
({phone})
{email}; {phone}
{phone}, {email}
{phone} / {phone}
{email}, {email}
Tel: {phone}
tel. {phone}
T {phone}
Phone {phone}
mobile {phone}
M: {phone} F: {phone}
Tel {phone} / fax {phone}
office {phone}, mobile {phone}
direct line {phone}
E-mail: {email}
email {email}
Mail {email}
{title}{name}
{title}{name}, {degree}
{name}, {degree}
{name} {degree}\n{role}\n{phone}\n{email}
{name}\n{role}, {sector}\n{phone}\n{email}
{name}\n{role}, {sector}\n{email}
{name}\n{role}\n{phone}
{title}{name}\n{role}\n{email}
{name}\n{phone}
{name}\n{email}
{name}\n{addr}\n{phone}
{name}\n{role}\n{name}\n{role}
{name}, {role}
{role}: {name}
Author: {name}
Prepared by {name}, {house} {kindword}
Reviewed by {name} and {name}
Written by {plain}, {plain} and {plain}.
Edited: {name} {email}
Ask {title}{name} at {phone}
Speak to {title}{name} on {phone} for the details.
For bookings ring {name} on {phone}.
Reach {name} under {phone} or at {email}.
Contact: {title}{name}, {phone}
Contact person {name}, telephone {phone}
Your contact {title}{name} is on {phone}
Contact {title}{name} via {email}
Please ring {phone} after nine.
Call {phone} to cancel the visit.
Call us on {phone} or {phone}.
The hotline {phone} is open day and night.
Our number has changed to {phone} since {month}.
Leave a message under {phone} if nobody answers.
Conference line {phone}, code follows.
Access number for the webcast: {phone}
Join by phone: {phone}
Reception can be reached at {phone} in office hours.
Text {phone} for a lift.
Answer to {email} before Monday.
Send your reply to {email} please.
Orders go to {email} by {month}.
Mail {email} and ask for a copy.
Files may be asked for at {email} until {month}.
Spreadsheet on request: {email}
Complaints: {email}
Comments on this paper: {email}
Sent on by <{email}> to all members.
The message came from {email} last night.
Fwd: {email} wrote to the team
Unsubscribe at {email}
Support is at {email}, day and night.
{name} ({phone}) led the tour.
{name} ({post}) answered the questions.
Dinner given by {name} ({post}).
The tour was led by {name}, {post}.
We spoke with {name}, {post}, in {month}.
We talked to {title}{name} in {month}.
{name}, {post}, opened the meeting.
{name}, {post}, met us in {city}.
{title}{name}, the {post}, spoke first.
{name} told us that orders fell in {month}.
{name} said the line will open in {month}.
As {name} explained, the price rises soon.
In the words of {name}, the worst is over.
According to our guest {name}, the strike ended.
According to {name} orders are up again.
according to {name}, who ought to know
According to {name} the new hall will be ready by {month}.
This is what {name} the other day called a start.
The prize went to {name} for her essay.
{name} and {name} read the draft.
Thanks to {plain}, {plain} and {title}{plain}.
Dear {title}{name},
Yours sincerely, {name}
My neighbour {name} has moved to {addr}.
{name} joined {house} {kindword} as {role}.
Since {month} {name} covers {sector} for {house}.
The chairman, {name}, will step down.
Photo: {name}
{house} appointed {name} {post}.
Send the forms to {name}, {addr}, or to {email}.
Papers to {title}{name}, {addr}.
Parcels for {name}, {addr} or {email}
Letters to {name}, {addr}.
Deliver to {addr} before noon.
Our new shop is at {addr}.
The offices have moved to {addr} in {month}.
Come and see us at {addr}, first floor.
Mail should be sent to {addr}.
The meeting takes place at {addr}, {city}.
The house at {addr}, {city} was sold.
The plant at {addr} is for sale.
Entrance by {addr}, ground floor.
Guests enter through {addr}.
Address: {addr}, {city}
{house} {kindword}, {addr}, {city}
{name} rents a flat at {addr}, second floor.
{name} of {addr} won the draw.
She lives at {addr}.
Visit to {addr}, third floor.
He gave his {idword} as {id}.
Please enter {idword} {id} in the form.
{idword}: {id}
{idword} {id}
The form names {idword} {id} as the holder.
The document shows {idword} {id} for the buyer.
The letter mentioned {idword}: {id}.
The notary wrote down {idword} {id}.
{name}, {idword} {id}, bought shares.
{name} ({idword} {id}) signed the deed.
{name}, {idword}: {id}, sold the flat.
The file lists {name} with {idword} {id}.
A clerk noted that {name} has {idword} {id}.
The applicant's {idword} {id} was checked.
""".strip().split("\n")
WITHOUT = r"""
ISIN {CC}{n10}
The note ({CC}{n10}) was repaid early.
Security {CC}{n10} trades below par.
WKN {n6}
Reference {n3}-{n3}-{n3}
File number {n3}-{n3}-{n3} of the archive.
Our case has the code {n2}-{n3}-{n3}.
Quote {n3}-{n3}-{n3} in all letters about this paper.
Invoice {n3} {n3} {n3} was paid.
There are {n2} {n3} {n3} shares in issue.
Shares outstanding: {n3} {n3} {n3}
The company has {n3} {n3} {n3} shares after the split.
After the merger {n2} {n3} {n3} votes are left.
Population {n1} {n3} {n3}
The town had {n3} {n3} people in 20{n2}.
Shares changed hands @ {n2}.{n1}x sales.
We value it @ {n1}.{n1}x book on page {n2}.
Sold {n3} units @ {n2}.{n1}x the list price on day {n2}.
Tickets @ {n2}.{n1} each
Release {n2}.{n1}.{n3} fixes {n3} bugs.
Version {n1}.{n2}.{n1}
Build {n3} follows {n2}.{n1}.{n3}.
Server 10.{n2}.{n1}.{n3} is down.
Ticket {n3}/{n3} was closed with {n2}.{n1}% left.
Batch {n3}/{n2}, size {n2}
Closing prices of {n2}.{n2}.20{n2}
Data of {n2}.{n2}.20{n2} at the close
On 20{n2}-{n2}-{n2} at {n2}:{n2}
Printed {n2}/{n2}/20{n2}
Due on {n2} {month} 20{n2}
{month} {n2}, 20{n2}
{n2} {month} 20{n2}
Checked by {house} legal, sheet {n2}
CHECKED BY {HOUSE} LEGAL, SHEET {n2}
Cleared for release by {house} control, no. {n2}
{HOUSE} EQUITY RESEARCH
Share of ratings: {n2}% buy, {n2}% hold
Ratings in our list: buy {n2}, hold {n2}, sell {n1}
Page {n1}
Page {n2} of {n2}
- {n2} -
Sheet {n1} / {n2}
(c) {house} {n4}
© {n4} {house} {kindword}. Reprint forbidden.
Copyright {n4} {house} {kindword}
From the {house} equity team
By the economists of {house}
{house} {kindword} desk
{house} and its staff may own the shares discussed above.
{house} makes a market in these shares.
Sign up for the daily letter of {house}
The daily letter of {house} comes every morning
{house} publishes this paper for trained readers only.
For use by clients of {house} {kindword} only
Pass it on through the portal of {house}
{house} | Research | Do not forward
{house} {kindword}
{house} {sector}
{house} {sector} {n4}
{house} {kindword}, {city}
{house} {house}
The {house} group
{house} Holding AG
{house} {sector} plc
Share | Print | Mail | Save
Forward to a friend | Print this page | Close
Subscribe | Contact | Imprint | Help
Menu Home News Contact
Past gains are no guide to future gains.
Terms and notices are printed on the back
Please see the notices at the end of the paper
The model is shown on the back page
These views are those of the writers alone.
This mail may hold secrets; delete it if it came by mistake.
All figures in {CUR}m unless noted
Figures are in {CUR} thousand, except per share data
{house} {sector}: a better return on capital after the capital markets day
{house} {sector}: weak footfall, strong pricing
{house} {sector}: what to expect from the results
{house} {sector} {n2} {month} 20{n2}, Buy
{house} {sector}, rated Sell since {month}
{house} {sector} model
{house} {sector} figures at a glance
Main figures {house} {sector}
Numbers for {house} {sector}
At a glance: {house} {sector}
Overview {house} {sector}
Our figures {house} {sector}
Summary table {house} {sector}
Our model {house} {sector}
Changes in our figures: {house} {sector}
Changed forecasts ({house} {sector})
Reuters {TICK}.{CC}
Ticker: {TICK} {CC}
{TICK} {CC} Equity
{TICK}.{CC} / {TICK} {CC}
Reuters: {TICK}.X, ticker {TICK} {CC}
{TICK}{CC}|{TICK}.X
Sales 20{n2}e rise to {CUR} {n3}.{n1}m from {CUR} {n3}.{n2}m.
We now see {CUR} {n3}.{n1}m of EBIT in 20{n2}, not {CUR} {n3}.{n2}m.
We lift our price target to {CUR} {n3}.{n1} from {CUR} {n3}.{n1}.
We trim 20{n2} EPS from {n1}.{n2} to {n1}.{n2}.
EPS H{n1} 20{n2}E drops to {n1}.{n2} from {n1}.{n2}.
Profit Q{n1} 20{n2}E now {n3},{n3} after {n3},{n3} before.
Sales FY{n2}E {CUR} {n3}.{n1}m
EBITDA 20{n2}E {CUR} {n3}.{n1}m
EBIT H{n1} 20{n2}E {n4}.{n3}
margin FY20{n2}E {n2}.{n2}%
price target {CUR} {n3}.{n1}
book value a share Q{n1} 20{n2}E {n1}.{n2}
deposits 20{n2}E {n3},{n3},{n3}
assets 20{n2}E {n3} {n3} {n3}
spending FY{n2}E (T{CUR} {n3},{n3})
ROCE FY{n2}E {n1},{n3} bps
profit Q{n1} 20{n2}E ({n4}.{n3})
tax burden H{n1} 20{n2}E {n1},{n3} bps
tax rate 20{n2}E {n2}.{n2}%
taxes H{n1} 20{n2}E -0.{n4}
charge for taxes FY20{n2}E (0.{n3})
Source: own data, estimates of the team
Source: company reports
interest H{n1} 20{n2}E {CUR} ({n4}.{n3})m
costs 20{n2}E -{n3} mln {CUR}
equity 20{n2}E {CUR} '000 {n8}
profit H{n1} FY20{n2}E {CUR} {n10}
gross income 20{n2}E {CUR}{n9}
cash flow 20{n2}E {CUR} {n2},{n3},{n3}
We put capital spending 20{n2}E at {CUR} '000 {n8}, up from {CUR} '000 {n2},{n3},{n3}.
loans {n7} {n7} {n7}
20{n2} {n3}.{n1} {n3}.{n2} {n3}.{n1}
Item Old New Diff
Year Sales Profit Dividend
Line Last Next Consensus
Better mix and lower costs carry the second half.
{house} {sector} spent more on the launch in {city} than the market thought.
The {city} plant runs well though rivals cut prices.
Lower freight costs and a weak tax base offset each other.
Our survey points to slower demand in the next quarters (рынок).
Energy costs stay high (利益), and wages rise.
Higher volumes prove the point of the new plant.
The board of {house} {sector} sticks to its outlook.
Loans grew, and so did the deposits, says the {city} branch.
{house} {sector}'s {city} unit lost share after the fire.
{house} {sector}'s auditor asked for a new test.
{house} {sector}'s cash flow leaves room for a higher dividend.
{house} {sector} gave a better outlook in {month}.
Management of {house} {sector} saw no reason to worry.
Peers trade at a discount to {house} {sector}.
{role}, {sector}
{role}
{sector} team
{city}, {n2} {month} 20{n2}
{city} and {city} come first.
The fair in {city} opens in {month}.
{house} {kindword} sees {n2} deals this year.
Head of Sales, {city} office
The Bank of {city} holds its rate.
Prime Minister meets Finance Minister in {city}
Good Friday and Easter Monday are holidays.
The European Central Bank cut rates in {month}.
New York and Los Angeles lead the ranking.
Summer School in {city}: Music and Dance
Green Energy Fund II, Class B
Buy Hold Sell
Strong Buy
Outperform
Not for sale in Japan, Canada or the United States
See https://www.{word}.example/{word}/{n4}
Visit www.{word}.example for more.
@{word} on all channels
{word} at home and at work
Item (at) cost
The ratio [dot] product is written with a point.
Room {n3}, level {n1}
Flight {CC} {n3} leaves at {n2}.{n2}
Platform {n1}, track {n2}
Chapter {n2}: The Long Road
Figure {n1}.{n1}: Street consensus
Street consensus is {n2}% lower.
The road ahead: {n2} slides
Section {n2}b of the act
Line {n2} runs from {city} to {city}.
Size {n2} x {n2} cm, {n1}.{n1} kg
Score {n1}:{n1}
{n2}% of {n3} answers
{n3} of {n4} seats were taken.
Nearly {n2} {n3} visitors came to {city}.
Serial number {n4}-{n4}-{n4}
Order {n8} has shipped.
Barcode {n13}
Article {n6}, {n2} pieces
""".strip().split("\n")
GIVEN = (
    "Anna Bruno Carla David Elena Felix Greta Henrik Irina Jonas Karin Lars Maria Nadia Oscar Paula Quentin Rosa Stefan Teresa Ulrich Vera Walter Yvonne Zoë André Hélène Jürgen Søren Mei-Ling Jean-Luc Anne-Marie Priya Ravi Kenji Haruka Yusuf Farid"
    " Chiara Marta Ingrid Linnea Saskia Thomas James Robert Susan Margaret Victoria William Patricia Theodore Christopher Elizabeth Alexander Guillermo Giuseppe Dimitrios Aleksandra Katherine Johannes Matthias Francesca Samantha Jennifer Nicholas Edward"
    " Richard Michael Deborah Rebecca Benjamin Anthony Andrew Ayumi Hiroshi Yuki Takeshi Grzegorz Zbigniew Agnieszka Wojciech Nguyen Minh Linh Kwame Olumide Chidi Ngozi Fatima Omar Layla Ahmed Hassan Amina Mohammed Ali Reza Leila Sanjay Anjali Deepak"
    " Kavita Arjun Wei Xiu Jian Hui Min-Jun Seo-Yeon Ji-Woo Olga Sergei Dmitri Natalia Ivan Svetlana Boris Milan Jelena Marko Ana Luka Petra Tomáš Jiří Eva Zsófia László Gábor Ilona Ioana Mihai Elif Mehmet Ayşe Paulo Eleni Giorgos Nikos Sofia Mateo"
    " Lucía Diego Bettina Gabriele Santiago Inés João Beatriz Tiago Rafael Luiza Pierre Ludovic Antoine Chloé Bastien Sven Astrid Bjørn Freja Mikkel Aino Eero Sigríður Gunnar Siobhán Declan Niamh Rhys Cerys Liam Emma Noah Olivia Ethan Mia Lucas Amelia"
).split()
FAMILIES = (
    "Tanaka Suzuki Kobayashi Brzeczyszczykiewicz Kowalska Wiśniewski Nowak Tran Pham Vo Mensah Okafor Adeyemi Diallo Haddad Mansour Rahimi Hosseini Sharma Patel Iyer Banerjee Chowdhury Zhang Li Wang Chen Park Kim Choi Ivanova Petrov Sokolov Volkova"
    " Jovanović Horvat Novák Dvořák Svoboda Nagy Szabó Kovács Popescu Ionescu Yılmaz Demir Papadopoulos Nikolaidis García Fernández Rodríguez Morales Silva Santos Oliveira Costa Dubois Lefèvre Moreau Girard Andersson Lindqvist Hansen Nielsen Virtanen"
    " Korhonen Jónsdóttir Murphy O'Brien O'Neill Evans Davies Smith Johnson Brown Taylor Walker Harris Clarke Wright Green Baker Cooper Ward Hughes Müller Schmidt Fischer Weber Wagner Becker Hoffmann Schäfer Rossi Ferrari Bianchi Romano Ricci Greco"
    " Janssen Peeters Vermeulen Bakker Visser Smit Keller Huber Gruber Steiner"
).split()
_PARTICLES = ["van ", "van der ", "de ", "von ", "di ", "Al-", "Mc", "Ben ", "da ", "Le "]
STREETS = "Orchard Baker Rose Castle Elm Maple Cedar Park Church Victoria Queen King Albert River Hill Forest Spring North Market Bell Crown Swan Stone Bishop Rowan Willow Laurel Priory Union Temple Windmill Kennedy Lincoln Washington Jefferson Madison Franklin Clinton Grant Sherman Hudson".split()
LATIN_STREETS = ["de la Paix", "Lafayette", "du Moulin", "Victor Hugo", "des Lilas", "Saint-Jacques", "Mayor", "Alcalá", "de Serrano", "Roma", "Garibaldi", "Dante", "San Marco", "Verdi", "Augusta", "da Liberdade", "Molière", "Bellini", "Goya", "Colón"]
GERMAN_STREETS = "Haupt Garten Schul Berg Linden Bahnhof Goethe Schiller Kirch Wald Mühlen Ring Rosen Garten Markt Hafen Königs Heide".split()
CITIES = "Vienna Oslo Dublin Lisbon Bergen Naples Tampere Rotterdam Gdańsk Bruges Nantes Leipzig Bristol Córdoba Malmö Århus Zürich".split() + ["São Paulo", "New Delhi", "Hong Kong", "Cape Town"]
SECTORS = "Re Holdings Chemicals Energy Foods Logistics Media Retail Telecom Industries Bancorp Utilities Software Steel Pharma Motors Airlines Insurance Real-Estate Mining Paper Semiconductors".split()
KINDWORDS = "Securities Research Bank Partners Group Equities Brokerage Advisors Holding Trust".split() + ["Capital Markets", "Investment Research", "& Co", "Asset Management", "& Sons"]
ROLES = ["Director", "Senior analyst", "Analyst", "Vice President", "Head of Research", "Associate", "Economist", "Managing Director", "Strategist", "Junior analyst", "Secretary"]
POSTS = ["Chief Executive", "Chief Financial Officer", "Plant Manager", "Treasurer", "Head of Investor Relations", "Chairman", "Head of Sales", "Finance Director", "Mayor", "Captain", "Chief Economist", "Plant Director"]
MONTHS = "January February March April May June July August September October November December".split()
DEGREES = ["CFA", "PhD", "MBA", "FRM", "CPA", "MD"]
WORDS = (
    "about after again all also although always among and another any are area as asked at back be because been before began behind below better between big bought bring but by call came can cannot case change clear close come could day decided deep done down during each early"
    " either end enough even every expects fair far few field find first follow for form found four free from full further gave get give given good great group grew had half hand has have he held help her here high him his home hope how if in into is it its just keep kind know large"
    " last late later least left less light like line little long look low made main make many may mean met might more most move much must named near need never new next no not now number of off office old on once one only open or order other our out over own paid part past place plan"
    " plant point price"
).split()
CURRENCIES = "EUR USD GBP CHF SEK JPY NOK DKK".split()


def _part(values: list[str], held: bool) -> list[str]:
    """The values kept out of the training, or the others."""
    return [v for i, v in enumerate(values) if (i % HELD == HELD - 1) == held]


def _made(r: random.Random) -> str:
    """An invented family name or house."""
    s = "".join(r.choice("bdfgklmnprstvzhjcw") + r.choice("aeiouaeiouáéíöüø" if r.random() < 0.15 else "aeiou") for _ in range(r.randint(1, 4))) + r.choice(["", "n", "r", "s", "x", "ll", "rt", "nd", "son", "mann", "ez", "ova", "sky", "berg", "t", "k", "m", "p"])
    return s.capitalize() if len(s) > 2 else "Bern" + s


def _family(r: random.Random, new: bool) -> str:
    s = _made(r) if new or r.random() < 0.6 else r.choice(FAMILIES)
    if r.random() < 0.05:
        s = r.choice(_PARTICLES) + s
    return s + ("-" + _made(r) if r.random() < 0.06 else "")


def _house(r: random.Random) -> str:
    return _made(r) + r.choice(["", "", r.choice(["ford", "ley", "moor", "stone", "combe", "bury"]), r.choice(["via", "dia", "ra", "tra", "nia", "mar", "tis", "on", "vento", "lia"])]) + r.choice(["", " " + _made(r), " " + r.choice(["Strathe", "Vale", "Bridge", "Hill", "Marsh"])])


def _address(r: random.Random, new: bool) -> str:
    s, latin, german, n = r.choice(STREETS), r.choice(LATIN_STREETS), r.choice(GERMAN_STREETS), str(r.randint(1, 290))
    s = _made(r) if new or r.random() < 0.3 else s
    two = f"{s} {r.choice(STREETS)}" if r.random() < 0.15 else s
    long, short = r.choice(["Street", "Road", "Lane", "Avenue", "Row", "Close", "Square", "Drive", "Place", "Way", "Terrace", "Court"]), r.choice(["St.", "Rd", "Rd.", "Ave", "St", "Ln", "Sq."])
    latin = r.choice([latin, latin, s, f"{r.choice(['de la', 'de', 'du', 'des'])} {_made(r)}"])
    german = r.choice([german, s])
    return r.choice([
        f"{n} {two} {long}", f"{n} {two} {long}", f"{n}{r.choice('ABC')} {two} {long}", f"{n}{r.choice('AB')} {s} {short}", f"{n}-{int(n) + 2} {s} {r.choice([long, short])}", f"{german}{r.choice(['strasse', 'straße', 'gasse', 'allee', 'weg', 'platz'])} {n}", f"{german}{r.choice(['straße', 'weg'])} {n}{r.choice('abc')}",
        f"{s}{r.choice(['laan', 'straat', 'gracht', 'kade', 'plein'])} {n}", f"{n} {r.choice(['rue', 'avenue', 'place', 'quai', 'Rue'])} {latin}", f"{r.choice(['Via', 'Piazza', 'Corso', 'Viale'])} {latin}{r.choice([', ', ' '])}{n}", f"{r.choice(['Calle', 'Avenida', 'Plaza', 'Rua'])} {latin}{r.choice([' ', ' ', ', '])}{n}",
    ])


def _identity(r: random.Random) -> tuple[str, str]:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    two = lambda: "".join(r.choice("ABCEGHJKLMNPRSTWXYZQ") for _ in range(2))
    word, form = r.choice([
        ("tax id", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("tax number", f"{d(2)}/{d(3)}/{d(5)}"), ("tax id", d(11)), ("SSN", f"{d(3)} {d(2)} {d(4)}"), ("social security number", f"{d(3)}-{d(2)}-{d(4)}"), ("SSN", f"{d(3)}-{d(2)}-{d(4)}"), ("passport", f"{two()}{d(7)}"), ("passport no.", f"{r.choice('CFGHXL')}{d(7)}"),
        ("passport number", f"{r.choice('CFGHXL')}0{d(6)}"), ("NI no.", f"{two()}{d(6)}{r.choice('ABCD')}"), ("national insurance number", f"{two()} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}"), ("identity card", f"{d(8)}{r.choice('ABCDGHRTWXYZ')}"), ("ID card", f"{two()}{d(6)}"), ("identity number", f"{d(6)} {d(4)} {d(3)}"),
    ])
    return (word[0].upper() + word[1:] if r.random() < 0.1 else word), form


def _phone(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice([
        f"+44 20 {d(4)} {d(4)}", f"+44 161 {d(3)} {d(4)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49 {d(3)} {d(7)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(2)}/{d(7)}", f"0{d(2)} {d(4)} {d(4)}",
        f"0044 (0){d(2)} {d(4)} {d(4)}", f"+44(0){d(10)}", f"+44 (0)20 {d(4)} {d(4)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"+39 0{d(1)} {d(4)} {d(4)}", f"00{d(2)} {d(2)} {d(7)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+41 {d(2)} {d(3)} {d(2)} {d(2)}",
    ])


def _email(r: random.Random, new: bool) -> str:
    plain = lambda s: re.sub(r"[^a-z0-9-]", "", s.lower().translate(str.maketrans("áéíöüøäëóúñçãõèêàâôûîßšžćčřýğışłńźżś", "aeiouoaeouncaoeeaaouisszccrygislnzzs")))
    f, g, h = plain(_family(r, new)), plain(r.choice(GIVEN)), plain(_made(r)) + r.choice(["", plain(_made(r)), "-" + plain(_made(r))])
    local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{f}{g[:1]}", f"{g[:1]}.{f}", f"{g[:1]}{f}", f"{f}{r.randint(1, 99)}", r.choice(["info", "office", "research", "sales", "press", "team", "desk", "help"])]) + r.choice(["", "", "", "", "+news", "+list"])
    at, dot = r.choice([("@", ".")] * 6 + [(" @ ", "."), (" (at) ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", ".")])
    e = f"{local}{at}{h}{dot}{r.choice(['example', 'example', 'com', 'org', 'net', 'co.uk', 'de', 'test'])}"
    return e.upper() if r.random() < 0.12 else e


def _name(r: random.Random, new: bool) -> str:
    """A name as people write it; new: of a given and a family name that no list has."""
    unlisted = new or r.random() < UNLISTED
    g, f, i = _made(r) if unlisted else r.choice(GIVEN), _family(r, new), r.choice("ABCDEFGHJKLMNPRST")
    return r.choice([f"{g} {f}"] * 9 + [f"{f}, {g}", f"{f}, {g}", f"{g} {i}. {f}", f"{g} {i}. {f}", f"{i}. {f}", f"{i} {f}", f"{f.upper()} {g}", f"{g.upper()} {f.upper()}", f"{f} {i}.", f"{f}, {i}. {r.choice('ABCDEF')}.", f"{f}, {i}.", f"{g} {r.choice(GIVEN)} {f}", f"{i}.{r.choice('ABCDEF')}. {f}"])


def _value(slot: str, r: random.Random, new: bool) -> str:
    if re.fullmatch(r"n\d+", slot):
        return "".join(r.choice("0123456789") for _ in range(int(slot[1:])))
    return {
        "name": lambda: _name(r, new), "plain": lambda: f"{r.choice(GIVEN) if not new else _made(r)} {_family(r, new)}", "email": lambda: _email(r, new), "phone": lambda: _phone(r), "addr": lambda: _address(r, new), "title": lambda: r.choice(["Mr ", "Ms ", "Dr ", "Mrs ", "Prof. ", "Mr. ", "", ""]), "house": lambda: _house(r), "HOUSE": lambda: _house(r).upper(), "city": lambda: r.choice(CITIES),
        "sector": lambda: r.choice(SECTORS), "kindword": lambda: r.choice(KINDWORDS), "role": lambda: r.choice(ROLES), "post": lambda: r.choice(POSTS), "month": lambda: r.choice(MONTHS), "degree": lambda: r.choice(DEGREES), "word": lambda: _made(r).lower(), "CUR": lambda: r.choice(CURRENCIES), "CC": lambda: r.choice("GY FP LN US SW IM SS DC GR NA XS DE FR".split()),
        "TICK": lambda: "".join(r.choice("ABCDEFGHKLMNOPRSTVXZ") for _ in range(r.randint(3, 4))),
    }[slot]()


_DETAILS = ["{name}"] * 6 + ["{title}{name}", "{name} ({post})", "{name}, {post},", "{name} and {name}", "{name} or {email}", "{name}, {addr}", "{phone}", "{phone}", "{email}", "{email}", "{addr}", "{addr}", "{addr}", "{addr}, second floor", "{addr}, {city}", "{idword} {id}", "{idword} {id}", "{idword}: {id}", "{name} ({phone})", "{phone} or {phone}", "{phone} / {phone}", "{name} | {email}", "{name} the", "{plain}, {plain} and {plain}", "{plain}, {title}{plain}", "{plain}, {plain}, {plain}", "{name}, {idword} {id},", "tel {phone} / mobile {phone}"]
_OTHERS = ["{house} {sector}"] * 4 + ["{house} {kindword}"] * 3 + "{house}|{house}|{city}|{house} {sector}'s|{house} {sector}'s {city} plant|{house}'s|{n3}-{n3}-{n3}|{n2}-{n3}-{n3}|{n3} {n3} {n3}|{n2} {n3} {n3}|{month} 20{n2}|{n2} {month} 20{n2}|{TICK} {CC}|{CUR} {n3}.{n1}m|{CUR} {n4}|{role}|{post}|{CC}{n10}|{n1}.{n1}x|{n2}.{n1}.{n3}|20{n2}|{house} and {house}|{house} {sector} in {city}|{n2} pages|{house} {house} {kindword}|{n3}/{n3}|{n3}|{n3} units|{n2} {n3}|H{n1} 20{n2}E|{house} {sector} on {n2} {month} 20{n2}|{house} {sector}: the|{n3}-{n3}-{n3}|the {house}|the {house} {kindword} team|{HOUSE}|{HOUSE} |{house} {kindword} | {sector}|by {house}|By the {house}|{house} Re|{house} Re|{house} Re:|{house} {kindword}, {city}|{post}, {city}|{role}, {city} office|above-{word} {word}|low-{word} {word}".split("|")
_CAPITALS = 0.1  # of the lines without details are in capitals
_LITERAL = re.compile(r"(?<![\w{])[A-Za-z]?[a-z]{2,}(?![\w}])")


def _word(r: random.Random) -> str:
    return r.choice(WORDS) if r.random() < 0.8 else _made(r).lower()


def _carrier(r: random.Random) -> str:
    """A template of a detail or another item among random words."""
    before, after = [_word(r) for _ in range(r.randint(0, 5))], [_word(r) for _ in range(r.randint(0, 5))]
    if before:
        before[0] = before[0].capitalize()
    item = r.choice(_DETAILS if r.random() < 0.55 else _OTHERS)
    mark = r.choice(["", "", "", ",", ":", ";"]) if after and not item.endswith(",") else ""
    return " ".join([*before, item + mark, *after]) + r.choice([".", ".", "", "?"])


def _reworded(template: str, r: random.Random) -> str:
    """The template with some of its words exchanged."""
    return _LITERAL.sub(lambda m: m[0] if r.random() < 0.8 else _word(r).capitalize() if m[0][0].isupper() else _word(r), template)


def fill(template: str, r: random.Random, new: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """(text, [(start, end, kind)]) of a filled template."""
    out, spans, at, pair = "", [], 0, _identity(r)
    template = template.replace("\\n", "\n")
    for m in re.finditer(r"\{(\w+)\}", template):
        out += template[at : m.start()]
        v = pair[0] if m[1] == "idword" else pair[1] if m[1] == "id" else _value(m[1], r, new)
        if m[1] in _SLOT_KIND:
            spans.append((len(out), len(out) + len(v), _SLOT_KIND[m[1]]))
        out, at = out + v, m.end()
    return out + template[at:], spans


def labelled_table(n: int = 6000, seed: int = 7, held: bool = False, new_names: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n labelled texts of one to five filled templates; held: of those kept out of the training, new_names: with names that no list has."""
    r = random.Random(seed)
    with_details, without = _part(WITH_DETAILS, held), _part(WITHOUT, held)
    rows = []
    for i in range(n):
        text, spans = "", []
        lines = [r.choice(with_details if r.random() < 0.5 else without) for _ in range(1 if i % 4 == 0 else r.randint(1, 5))]
        for line in lines:
            if not held:
                line = _carrier(r) if r.random() < 0.5 else _reworded(line, r)
            t, s = fill(line, r, new_names)
            t = t.upper() if not s and r.random() < _CAPITALS else t
            base = len(text) + (1 if text else 0)
            text = f"{text}\n{t}" if text else t
            spans += [(a + base, b + base, k) for a, b, k in s]
        rows.append((text, spans))
    return rows
