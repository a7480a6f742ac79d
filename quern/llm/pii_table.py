"""The small labelled table from which the personal-information model is trained.

Each line is a text in which {person}, {email}, {phone}, {id_number} and {address} stand for labelled
items and the other braces for fillers that are no cases. Items and fillers are made by rule from the
lists below with a fixed seed. The lines are general business and everyday phrasing in four languages,
names are frequent public ones mixed with made-up words, and made-up words of the same kind stand for
places, products and firms, so the model has to go by context and shape. No sentence or name is copied
from the tables it is run on, but the layout of some lines of LOOSE (running lines such as "n | place"
or "name, Rev. n", keys of rows, notes after a list of copies) was added after looking at what the model
got wrong on chunks of sf0.1.
"""

from __future__ import annotations

import random

KINDS = ("email", "phone", "id_number", "address", "person")

#: Frequent given names in English-, French-, German- and Spanish-speaking countries.
FIRST = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Nancy Daniel Lisa Matthew Betty Anthony Margaret Mark Sandra "
    "Paul Ashley Steven Emily Andrew Kimberly Kevin Donna Brian Michelle George Carol Edward Amanda Jean Pierre Marie Nathalie Isabelle Michel Alain Sylvie Nicolas Camille Claire Sophie Laurent Chantal Luc Manon Hans "
    "Peter Ursula Monika Klaus Petra Stefan Sabine Andreas Birgit Wolfgang Karin Jürgen Anna Lukas Lena Felix Jonas Katrin Antonio Carmen José Ana Manuel Dolores Francisco Pilar Juan Teresa Javier Rosa Carlos Lucía "
    "Miguel Elena Pedro Laura Diego Marta Rajesh Priya Amit Wei Li Ahmed Fatima Mohammed Aisha Olga Ivan Yuki Kenji Tim Rachel Oscar Ingrid Nadia Hugo Greta Clara Bruno Emma Noah Olivia Liam "
    "Aaron Adam Adrian Agnes Alan Alba Albert Alexander Alice Alicia Alma Amelia Anton Arthur Astrid Aurora Axel Beatriz Benjamin Bernd Carla Caroline Cecilia Celia Chloe Christian Christine Claudia Cora Cristina Dario "
    "Dominik Dorothea Edith Edwin Eleanor Elias Elisa Ella Elsa Emil Enzo Erik Esteban Esther Eva Evelyn Fabian Fernando Finn Florian Frank Freya Frida Gabriel Gerhard Gideon Gloria Gustav Hannah Harold Heidi Heinz Helena "
    "Henry Hilda Ian Ida Ines Irene Iris Isaac Isabel Jack Jakob Jan Jana Jasmin Joan Johanna Jonathan Jorge Josephine Julia Julian Julien Karl Katharina Kurt Leon Leonie Lina Lorenzo Louis Lucas Ludwig Luis Luna Mara Marc"
).split()
#: Frequent family names of the same countries.
FAMILY = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter "
    "Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Neumann Schwarz Zimmermann Krüger Hartmann Lange "
    "Bernard Dubois Durand Petit Moreau Laurent Lefebvre Leroy Roux Fournier Girard Bonnet Lambert Rousseau García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Díaz Ruiz Hernández Álvarez Romero "
    "Kumar Singh Patel Chen Wang Khan Ali O'Neill O'Brien McDonald Nguyen Kowalski Novak Jensen Hansen Larsson Rossi Ricci Silva Santos"
).split()
PLACE = (
    "London Paris Berlin Madrid Rome Vienna Hamburg Munich Lyon Seville Boston Chicago Dublin Oxford Bristol Geneva Lisbon Prague Warsaw Oslo Dover Malta Europe Spain France Germany Italy Denver Dallas Toronto Sydney "
    "Köln Stuttgart Dresden Zürich Marseille Toulouse Bordeaux Nantes Valencia Bilbao Málaga Granada Leeds York Cambridge Austin Houston Atlanta Seattle Miami Lima Bogotá Texas Kent Essex Bayern Provence Galicia"
).split()
STREET = "Street Road Lane Avenue Drive Way Court Close Row Terrace".split()
MONTH = "January February March April May June July August September October November December".split()
FIRM = "GmbH Ltd Inc AG SA Group Holdings Partners Logistics Consulting Systems Networks Supply Works Labs Storage".split()
NOUN = (
    "report invoice contract printer laptop server backup password meeting budget order delivery warranty manual catalogue project product service account balance schedule shipment policy form application request "
    "agreement database network router cable screen keyboard licence certificate survey training workshop visit inspection audit review summary minutes protocol register list table chart folder archive record "
    "department branch warehouse desk room floor entrance lobby canteen garage elevator badge key door gate parcel letter envelope stamp package machine engine pump valve sensor controller module interface release "
    "upgrade patch rollback snapshot queue bucket cluster volume disk image node dashboard alert ticket incident change problem exception quota threshold plan roadmap milestone deadline holiday leave overtime salary "
    "pension insurance claim payment refund discount price tax fee charge cost quote tender supplier customer vendor member visitor guest tenant owner agent clerk guide handbook team group board committee council guild crew squad"
).split()
ADJECTIVE = "annual quarterly monthly new old final temporary internal external broken urgent spare late early large small public shared signed missing open closed manual remote local regional mobile digital general technical".split()
VERB = "check review move replace print sign approve reject send return repair order update close open test restart copy store archive book cancel confirm extend".split()
ROLE = "office manager|team lead|sales director|accountant|software engineer|project assistant|head of purchasing|site manager|nurse|personal assistant|support agent|consultant|warehouse clerk|lab technician|treasurer|secretary|driver|teacher|uncle|landlady|singer|captain|painter|plumber".split("|")
NOUN_DE = (
    "Rechnung Vertrag Drucker Lieferung Bestellung Anfrage Sitzung Vorlage Frist Abteilung Werkstatt Halle Tür Schlüssel Ausweis Bericht Protokoll Datei Ordner Rechner Netz Strom Heizung Wartung Prüfung Zahlung Gebühr Steuer "
    "Versicherung Urlaub Antrag Freigabe Meldung Störung Angebot Auftrag Kunde Lager Verwaltung Leitung Versand Buchhaltung Einkauf Vorstand Ausschuss Standort Betrieb Schicht Maschine Pumpe Anlage Entwurf Richtlinie Vorgang Stelle"
).split()
NOUN_FR = "facture contrat imprimante livraison commande demande réunion modèle délai service atelier porte clé rapport dossier serveur réseau chauffage contrôle paiement taxe assurance congé offre client dépôt direction achat comité site machine pompe projet".split()
NOUN_ES = "factura contrato impresora entrega pedido solicitud reunión plazo departamento taller puerta llave informe expediente servidor red calefacción control pago tasa seguro permiso oferta cliente almacén dirección compra comité sede máquina bomba proyecto".split()

#: {person}: a full name in any form; {named}: one that begins with a capital; {family}: a family name alone, after a title.
LINES = """
{named} joined the company in {month} and works as {role}.
We talked to {named} about the {adj} {noun} yesterday.
Yesterday {named} met {named} in {place} to discuss the {noun}.
Our chief executive {named} presented the {adj} {noun} to the {noun} {noun}.
{named} presented the results of the {noun} on {date}.
I asked {named} to {verb} the {noun}, but {named} was away.
Contact: {person}, {role}, {phone}, {email}
Contact: {named}, {address}, {id_label} {id_number}
Name: {person}\nPhone: {phone}\nE-mail: {email}\nAddress: {address}
Name: {person}; born {date}; {id_label}: {id_number}
Customer: {person}, {address}
name: {person}, role: {role}, tel: {phone}
user={person}, group={noun}, mail={email}, phone={phone}
employee={person}, dept={noun}, address={address}
owner={person}, {noun}={code}, status=open
full_name={person}, {noun}={n}, email={email}
"{named}","{phone}","{email}","{place}"
{named};{role};{email};{phone}
{person} | {role} | {phone}
Dear Mr {family}, thank you for your letter of {date}.
Dear Mrs. {family},\n\nyour {noun} has arrived.
Dear Mr. {family}, your {id_label} {id_number} is needed for the {noun}.
Dear {named}, please {verb} the {noun} before {date}.
Dr. {family} will see you at {n} o'clock in room {n}.
Prof. {family} and Dr. {named} wrote the {noun} together.
Ms {family} called about the {noun}; her number is {phone}.
Miss {family} left the {noun} with Sir {named}.
The {noun} was signed by {person} on {date}.
The {noun} was written by {named} and checked by {named}.
Approved: {person}. Copy to {person}.
Attendees: {named}, {named} and {named}.
Present: {person}; absent: {person}
From: {named} <{email}>\nTo: {named} <{email}>\nSubject: {adj} {noun}
From: {person}, {email}
cc: {person} ({email})
Please reply to {email} or call {phone}.
Write to {email} for the {adj} {noun}.
Send the {noun} to <{email}> or to {email}.
My address is {address} and my telephone number is {phone}.
Ship to: {person}, {address}
Ship it to {address}, care of {person}.
She lives at {address}.
They moved from {address} to {address} last {month}.
The {noun} at {address} was closed on {date}.
Deliver the {noun} to {address} and ring {phone}.
Visitors should go to {address} first.
Bill to {address}. Amount due: {amount}.
Fax {phone}, office {phone}.
Tel: {phone} / mobile: {phone}
Reach me on {phone} after {n} o'clock.
You can text {phone} or phone {phone}.
A caller from {phone} asked for the {noun} {n} times.
Emergency number: {phone} ({named})
The number {phone} is no longer in use; dial {phone}.
Her {id_label} is {id_number}.
His {id_label} ({id_number}) was copied onto the {noun}.
{id_label}: {id_number}
The applicant gave {id_label} {id_number} and a {noun} as proof.
Please check {id_label} {id_number} against the {noun} of {named}.
Two numbers were wrong: {id_label} {id_number} and {id_label} {id_number}.
{named}, holder of {id_label} {id_number}, lives at {address}.
Enter {id_label} {id_number} at the {noun}. The {noun} is open until {n}.
Best regards,\n{person}\n{Role}\n{phone}\n{email}
Regards,\n{person}\n{Role}\n{address}\nTel.: {phone}
Yours sincerely,\n\n{named}\n{Role}
Cheers,\n{named}
Many thanks\n{person}\n{Role}, {firm}\nMobile: {phone}\nMail: {email}
Sincerely,\n{person}\n{email}\n{address}\nThe {noun} of {place} will {verb} the {noun}.
{named}'s {noun} was found in the {noun} of {place}.
The {noun} belongs to {named}, not to {firm}.
Is {named} still on {noun} leave, or back at {firm}?
{person} reported a {adj} {noun}.
According to {named}, {firm} will {verb} the {noun} in {month}.
For questions about {project} ask {named} of {firm}.
- {named} will {verb} the {noun}
{n}. {named}: {verb} the {noun} by {date}
{stamp} INFO sign-in by {email} from {ip}
{stamp} WARN message to {email} bounced after {n} ms
{stamp} ERROR user {email} has no {noun}
login={email} result=ok
Herr {family} hat die {N} am {ddate} erhalten.
Frau {family} wohnt in der {address}.
Sehr geehrter Herr {family}, anbei die {N}.
Sehr geehrte Frau Dr. {family}, bitte prüfen Sie die {N}.
{named} leitet seit {month} die {N} in {place}.
Ansprechpartner ist {named}, Telefon {phone}, E-Mail {email}.
Mit freundlichen Grüßen\n{named}\n{phone}
Bitte rufen Sie {phone} an oder schreiben Sie an {email}.
Die Anschrift lautet {address}; {id_label} {id_number}.
Der {N} von {named} liegt bei Frau {family}.
Monsieur {family} a reçu la {f} le {n} mars.
Madame {family} habite au {address}.
Mme {family} et M. {family} ont signé la {f}.
Bonjour {named}, merci pour la {f}.
Cordialement,\n{named}\n{phone}\n{email}
Vous pouvez joindre {named} au {phone} ou par mail : {email}.
Adresse : {address}. Pièce : {id_label} {id_number}.
Le {f} de {named} est resté chez {firm} à {place}.
El señor {family} recibió la {s} el {n} de enero.
La señora {family} vive en {address}.
Sra. {family}: su {s} está lista. Sr. {family}: la suya no.
Estimada {named}, gracias por la {s}.
Un saludo,\n{named}\n{phone}
Puede llamar a {named} al {phone} o escribir a {email}.
Dirección: {address}; {id_label}: {id_number}
La {s} de {named} se quedó en {firm}, en {place}.
The {adj} {noun} of {project} is kept in {place}.
The {noun} {noun} was moved from {place} to {place} by {firm}.
{project} is a {adj} {noun} for {noun} and {noun}.
Project {project} replaces the {noun} of {firm} in {month}.
{firm} sells {noun} and {noun} in {place} for {amount} EUR.
{firm} and {firm} signed a {noun} about {project}.
{place} has a {adj} {noun} and {n} {noun} offices.
In {place}, the {noun} {noun} will {verb} the {noun}.
Open {project}, select {code} and {verb} the {noun}.
Case {code} refers to invoice {code} and serial number {digits4}-{digits4}-{digits4}.
Serial no. {digits4}-{digits3}-{digits6}, part {code}, order {digits6}.
Build {digits4}.{n}.{n} of {project}, version {n}.{n}.{digits4}.
The {noun} is at {ip}; port {digits4}, retries {n}.
Notify @{low}-team in the channel, then run {low}@{low}-{n}.
Install {low}@{n}.{n}.{n} or pull {low}/{low}:v{n}.{n}.
Room {n}, gate {n}, floor {n1}: the {noun} is next to the {noun}.
The {adj} {noun} costs {amount} USD, {n} percent more than in 2021.
On {date} the {noun} {noun} counted {amount} of {amount} {noun} units.
Section {n}.{n}: {Adj} {Noun} and {Noun}
{Project} {Adj} {Noun}
{Adj} {Noun} {project} - page {n}
# {Noun} {Noun} {project}\n\nThe {noun} is {adj}.
{UPPER} {UPPER}\nThe {noun} of {firm} is {adj}.
THE {UPPER} {UPPER} OF {UPPER} WILL {UPPER} THE {UPPER}.
{firm} - {project} {Noun} {Noun}\nThe {noun} is {adj}.
{Adj} {Noun} | {place} | {n}
Unless the {noun} {noun} objects, the {role} will {verb} the {adj} {noun}.
After {n} attempts the {noun} stops and the {role} gets a message.
Nobody except the {role} may {verb} the {noun}; ask the {noun} desk.
If the {noun} fails, {verb} the {noun}, then {verb} the {noun} of {project}.
Questions on the {noun} go to the {role} or the {noun} {noun}.
{noun}={code}, {noun}={amount}, {noun}={place}
{noun}={firm}, {noun}={digits4}, {noun}={code}, status=open
id={code}, {noun}={project}, due=2025-{n2}-{n2}, amount={amount}
{noun}_no={digits6}, year={digits4}, total={amount}
Quarter=Q{n1}, Sales={amount}, Costs={amount}, City={place}
{stamp} INFO {low} import for {firm} took {n} ms id={hex}
{stamp} ERROR {project} lost node {code} at {place} id={hex}
Traceback (most recent call last):\n  File "{low}.py", line {n}, in {low}\n{Project}Error: bad {noun}
    at com.{low}.{low}.run({Project}.java:{n})
Die {N} der {N} wurde von der {N} in {place} geprüft.
Der {N} {project} ersetzt die {N} von {firm} ab {ddate}.
Nach {n} Tagen geht die {N} an die {N}, sonst bleibt der {N} offen.
Ohne {N} darf niemand die {N} ändern; die {N} kostet {amount} Euro.
{firm} liefert die {N} erst im {month} nach {place}.
La {f} du {f} a été vérifiée par la {f} de {place}.
Le {f} {project} remplace la {f} de {firm} avant le {n} juin.
Après {n} essais, {project} prévient le {f} de {place}.
La {s} del {s} fue revisada por la {s} de {place}.
El {s} {project} sustituye la {s} de {firm} antes del {n} de junio.
Tras {n} intentos, {project} avisa al {s} de {place}.
{Poetic} is the name of the {adj} {noun} in {place}.
The {Poetic} {noun} meets in {place}, the {Poetic} {noun} does not.
""".strip().split("\n")

#: Items between words that say nothing of them, so that neither place nor wording of a sentence is learned by heart.
LOOSE = """
{Start} {ctx} {named} {ctx}.
{Start} {ctx} {named} {ctx} {noun}.
{Start} {ctx} {named} and {named} {ctx} {firm}.
{Start} {ctx} {person}, {email}, {ctx}.
{Start} {ctx} {person} ({phone}) {ctx}.
{ctx} {person}, {address}, {ctx} {place}.
{Cc} {person}, {email} {ctx} {code}.
{Cc} {person}; {ctx}.
{named} {ctx}.
{named}'s {noun} {ctx} {place}.
{Start} {ctx} {person}.\n{Start} {noun} {ctx}
{Start} {adj} {role}, {person}, {ctx} {id_label} {id_number} {ctx}.
{Start} {ctx} {title} {family} {ctx} {place}.
{title} {family} {ctx} {noun}.
{greet} {named}, {ctx}.
{greet} {title} {family}, {ctx}.
{Role} {named} {ctx}.
{Start} {noun} {Role} {named} {ctx}.
{named} and {named} {ctx} {noun}.
{Start} {ctx} {title} {named} {ctx}.
{Start} {ctx} {address} {ctx}.
{Start} {ctx} {address}, {ctx} {person}.
{ctx} {address}; {ctx}.
{Start} {ctx} {phone} {ctx}.
{ctx} {phone}, {ctx} {email} {ctx}.
{Start} {ctx} {id_label} {id_number} {ctx}.
{Start} {noun} {n} {ctx} {id_label} {id_number} {ctx} {id_label} {id_number}.
{ctx} {email} {ctx}.
{Start} {ctx} <{email}> {ctx}
{key}={person}, {key}={role}, {key}={phone}, {key}={email}, {key}={address}
{key}={person}, {key}={email}, {key}={digits4}-{digits4}
{key}={person}, {key}={noun}, {key}={digits4}-{digits4}, {key}={address}
{stamp} INFO {low}: {ctx} to {phone}
{stamp} WARN {low}: {ctx} for user={email} {ctx}
{bye},\n{person}\n{Role}\n{label} {phone}\n{label} {email}\n{address}\n{Start} {noun} {ctx}.
{bye},\n{person}\n{Role}\n{phone}\n{email}
{bye},\n{person}\n{Role}\n{address}\n{Start} {ctx}
{Start} {ctx}.\n\n{bye},\n{person}\n{Role}\n{label} {phone}\n{address}
{Start} {adj} {noun} {ctx} {place}.
{Start} {noun}, {project}, {ctx} {noun}.
{Start} {noun} {ctx}, {project}, {ctx} {firm}.
{Start} {N} {project} {ctx}. {Start} {f} {ctx} {project}. {Start} {s} {ctx} {place} {ctx}.
{n} | {place}
{Start} {ctx} {place}\n{n} | {place}\n{ctx}
{stamp} ERROR {low} {ctx} {project} {ctx}
{Start} {ctx} {noun} {Noun}: {ctx} {project}.
{Start} {adj}-{noun} {noun} {ctx} {project} {ctx}.
{Start} {ctx} {firm} {ctx} {project}.
{Start} {ctx} {code} {ctx} {project} {noun} {ctx} {place}.
{Start} {ctx} {place}. {Start} {ctx} {project} {ctx} {place}.
{project} {Noun}, Rev. {n}\n{Start} {ctx} {firm}.
   {project} {Adj} {Noun} | page {n}\n{n}.{n} {Adj} {noun}\n{Start} {ctx}
{project} {Noun} {Noun}\n{Start} {noun} {ctx} {noun} {ctx}.
   {UP2} {UPPER} {UPPER}\n{Start} {ctx} {noun}.
{firm} — {project} {Adj} {Noun}\n{Start} {ctx}
{Start} {ctx} {date} {ctx} {amount} {ctx}.
{L}{f} {n} {ctx} {f} {ctx} {code}.
{Start} {N} {ctx} {N} {ctx} {N} {place}.
{Start} {ctx} {Poetic} {ctx}.
{project} ships {date}; {ctx} {low}@{low} {ctx} @{low}.
"""
LOOSE = LOOSE.strip().split("\n")
_CTX = (
    "the of to in on with by for from at as and or that this which is was were has had will may can not only before after under over between per about until when since without within against because again never always "
    "der die das und mit von für bei nach auf ist wird nicht nur noch oder le la les de du des et avec pour par sur est sera pas dans el los con para por en es será no una un su y del"
).split()
_START = (
    "A|An|The|Every|Each|Please|During|Before|If|Unless|Most|Its|Our|Their|After|In|On|As|To|For|No|Nobody|Because|When|This|These|Parts|Costs|Questions|Training|Copies|Step|Form|Ticket|Version|Approved|"
    "Der|Die|Das|Ein|Eine|Nach|Bei|Ohne|Bitte|Im|Wegen|Le|La|Les|Un|Une|Après|Selon|Pour|Sans|À|El|Los|Una|Según|Tras|Para|Sin|En|Debido"
).split("|")


_WORDS = {
    "title": "Mr|Mr.|Mrs|Mrs.|Ms|Ms.|Dr.|Dr|Prof.|Miss|Herr|Herrn|Frau|Monsieur|M.|Madame|Mme|Señor|Señora|Sr.|Sra.".split("|"), "bye": "Best|Best regards|Kind regards|Regards|Thanks|Thank you|Sincerely|Yours|Best wishes|Viele Grüße|Cordialement|Bien à vous|Saludos|Un abrazo|Cheers|Love".split("|"),
    "greet": "Dear|Querido|Querida|Estimado|Estimada|Cher|Chère|Lieber|Liebe|Hello|Hi|Bonjour|Hola|Hallo".split("|"), "label": "Phone:|Tel.|Tel:|T:|Mobile|mobile|Cell:|E-mail:|Email|mail|Mail:|M:".split("|"), "Cc": "Cc|CC|cc|Copy to|Attention|For|By|Signed|c/o|With".split("|"),
    "key": "name|team|phone|contact|mail|home|address|owner|user|tel|email|ref|ticket|office|site|person|lead|city|dept|group".split("|"), "L": ["L'", "L’", "D'", "À l'", "Qu'"],
}
_ONSET = "b br c ch d dr f fl g gr h j k kl l m n p pl qu r s sh st t tr v w z th sw".split()
_NUCLEUS = "a e i o u ai ea ee ie oo ou au ei".split()
_CODA = "b ck d ff g l ld lm m n nd ng nt p r rd rk rn s sk st t th x".split()


class Maker:
    """Fills the braces of a line; returns pieces (text, kind or None)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, least: int = 1) -> str:
        """A made-up word of one to three syllables."""
        r = self.r
        return "".join(r.choice(_ONSET) + r.choice(_NUCLEUS) + (r.choice(_CODA) if r.random() < 0.55 else "") for _ in range(r.randint(least, 3))).capitalize()

    def family(self) -> str:
        r = self.r
        f = r.choice(FAMILY) if r.random() < 0.4 else self.word(2)
        return f"{f}-{self.word()}" if r.random() < 0.03 else f

    def first(self) -> str:
        return self.r.choice(FIRST) if self.r.random() < 0.75 else self.word(2)

    def named(self) -> str:
        r, f, l = self.r, self.first(), self.family()
        form = r.random()
        if form < 0.08:
            f = f"{f}-{self.first()}"
        elif form < 0.2:
            f = f"{f} {r.choice('ABCDEFGHIJKLMNOPRSTUVWZ')}."
        elif form < 0.3:
            f = f"{r.choice('ABCDEFGHIJKLMNOPRSTUVWZ')}."
        elif form < 0.4:
            l = f"{r.choice(['van', 'de', 'von', 'di', 'van der', 'del', 'de la', 'da'])} {l}"
        return f"{f} {l}"

    def person(self) -> str:
        form = self.r.random()
        if form < 0.12:
            return f"{self.family()}, {self.first()}"
        if form < 0.16:
            return f"{self.family()} {self.first()}"
        p = self.named()
        return p.upper() if form < 0.24 else p.lower() if form < 0.36 else p

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def email(self) -> str:
        r, d = self.r, self.d
        f, l, site = self.first().lower(), self.family().lower().replace("'", ""), self.word().lower()
        name = r.choice([f"{f}.{l}", f"{f}{d(2)}", f"{f[0]}{l}", f"{l}_{f}", f"{l}-{f[0]}", f"{f}.{l}+{d(2)}", f"{l}.{f}", f"{f}", r.choice(["info", "sales", "office", "help"])])
        sub = r.choice(["", "", "", "mail.", "eu.", "post.", "hr."])
        top = r.choice("com org net de fr es co.uk example test invalid io".split())
        form = r.random()
        if form < 0.06:
            return f"{name} (at) {sub.replace('.', ' (dot) ')}{site} (dot) {top}"
        if form < 0.1:
            return f"{name} [at] {sub}{site}.{top}"
        if form < 0.13:
            return f"{name} @ {sub}{site}.{top}"
        if form < 0.16:
            return f"{name} at {sub.replace('.', ' dot ')}{site} dot {top}"
        out = f"{name}@{sub}{site}.{top}"
        return out.upper() if form < 0.22 else out

    def phone(self) -> str:
        """Numbers as they are written in the countries of the four languages."""
        d, r = self.d, self.r
        return r.choice(
            [f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+1{d(10)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}",
             f"+44 {d(2)} {d(4)} {d(4)}", f"+44 (0){d(2)} {d(4)} {d(4)}", f"00{d(2)} (0){d(2)} {d(4)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"07{d(3)} {d(6)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49 {d(3)} {d(7)}", f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(3)}/{d(7)}", f"0{d(3)} {d(6)}",
             f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"{d(3)} {d(2)} {d(2)} {d(2)}"]
        )

    def id_pair(self) -> tuple[str, str]:
        """A label and a number as it is written in one of several countries."""
        r, d = self.r, self.d
        a = lambda n=1: "".join(r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(n))
        passport = r.choice([f"{a(1)}{d(8)}", f"{a(2)}{d(7)}", f"{d(9)}", f"{a(1)}{d(2)}{a(1)}{d(2)}{a(1)}{d(2)}", f"{d(2)}{a(2)}{d(5)}"])
        card = r.choice([f"{d(8)}-{a()}", f"{d(8)}{a()}", f"{a(1)}{d(7)}{a(1)}", f"{a(1)}{d(8)}"])
        tax = r.choice([f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(11)}", f"{d(3)}/{d(3)}/{d(5)}", f"{d(2)}-{d(7)}"])
        nino = f"{a(2)}{d(6)}{r.choice('ABCD')}"
        nino = nino if r.random() < 0.4 else f"{nino[:2]} {nino[2:4]} {nino[4:6]} {nino[6:8]} {nino[8]}"
        kinds = {
            "passport|passport number|passport no.|Passport No|travel document|Reisepass|passeport|pasaporte": passport, "identity card|ID card|identity number|personal ID|DNI|NIE|Personalausweis|carte d'identité|documento de identidad": card,
            "SSN|social security number|social security no.|Social Security": f"{d(3)}-{d(2)}-{d(4)}", "national insurance number|NI number|NINO|insurance number": nino, "tax id|tax number|personal tax number|TIN|Steuer-ID|numéro fiscal|número fiscal": tax,
        }
        labels = r.choice(list(kinds))
        return r.choice(labels.split("|")), kinds[labels]

    def address(self) -> str:
        r, d = self.r, self.d
        no, base, place = str(r.randint(1, 240)) + r.choice(["", "", "", "a", "b"]), self.word(), self.word()
        base = r.choice(["Main", "High", "Park", "Church", "Station", "Mill", "Oak", "Market", "Lincoln", "Victoria"]) if r.random() < 0.3 else base
        code = r.choice([d(5), f"{r.choice('BEGLMNSW')}{d(1)} {d(1)}{r.choice('ABDEJH')}{r.choice('ABDEJH')}", f"{r.choice('BLMSW')}{r.choice('AEWQX')}{d(1)} {d(1)}{r.choice('ABX')}{r.choice('ABX')}"])
        form = r.random()
        if form < 0.5:
            gap = r.choice([", ", ", ", ", ", "\n"])
            tail = r.choice(["", f" {code}", f", {code}", f" {code}"])
            return f"{no} {base} {r.choice(STREET)}{gap}{place}{tail}" if r.random() < 0.85 else f"{no} {base} {r.choice(STREET)}"
        if form < 0.7:
            street = base + r.choice(["straße", "str.", "weg", "gasse", "allee", "strasse", "platz", "ring", "damm"])
            return f"{street} {no}, {d(5)} {place}" if r.random() < 0.85 else f"{street} {no}"
        if form < 0.85:
            return f"{no}{r.choice(['', '', ' bis', ' ter'])}{r.choice([', ', ' '])}{r.choice(['rue', 'avenue', 'impasse', 'boulevard', 'place', 'chemin', 'allée'])} {r.choice(['de', 'du', 'des', 'de la'])} {base}, {d(5)} {place}"
        floor = f", {d(1)}º {r.choice('ABC')}" if r.random() < 0.6 else ""
        return f"{r.choice(['Calle', 'Avenida', 'Plaza', 'Paseo'])} {r.choice(['', 'de ', 'del '])}{base} {no}{floor}, {r.choice(['', d(5) + ' '])}{place}"

    def filler(self, name: str) -> str:
        r, d = self.r, self.d
        lists = {"noun": NOUN, "adj": ADJECTIVE, "verb": VERB, "role": ROLE, "N": NOUN_DE, "f": NOUN_FR, "s": NOUN_ES, "month": MONTH}
        if name in lists:
            return r.choice(lists[name])
        if name in ("Noun", "Adj", "Role"):
            return r.choice({"Noun": NOUN, "Adj": ADJECTIVE, "Role": ROLE}[name]).capitalize()
        if name == "ctx":
            return " ".join(r.choice(r.choice([_CTX, _CTX, NOUN, VERB, ADJECTIVE])) for _ in range(r.randint(1, 5)))
        if name == "Start":
            return r.choice(_START) if r.random() < 0.8 else r.choice(r.choice([NOUN, VERB, NOUN_DE, NOUN_FR, NOUN_ES])).capitalize()
        if name in ("title", "bye", "greet", "label", "Cc", "key", "L"):
            return r.choice(_WORDS[name])
        if name == "UP2":
            return self.word(2).upper()
        if name == "UPPER":
            return r.choice([r.choice(NOUN), r.choice(ADJECTIVE), self.word()]).upper()
        if name == "place" and r.random() < 0.35:
            return r.choice(PLACE)
        if name in ("place", "project", "Project"):
            return self.word(2)
        if name == "low":
            return self.word().lower()
        if name == "firm" and r.random() < 0.1:
            return r.choice("Siemens Toyota Nestlé Renault Airbus Sony Intel Philips Volvo Pepsi Adidas Bosch".split())
        if name == "firm":
            return f"{self.word()} {r.choice(FIRM)}" if r.random() < 0.8 else f"{self.word()} & {self.word()}"
        if name == "Poetic":
            return f"{r.choice('Red Golden Quiet Winter Morning Iron Paper River Coral Second'.split())} {r.choice('Garden Tower Mirror Forest Bell Ocean Letter Valley Window Crown'.split())}"
        if name == "code":
            w = self.word()
            return r.choice([f"{w[:3].upper()}-{d(5)}", f"{r.choice('ABCDIPRT')}{r.choice('NORXQ')}-{d(4)}", f"{w.lower()}_v{d(1)}.{d(2)}", f"{w}-{r.choice(NOUN)}-{d(2)}", f"{r.choice(NOUN).capitalize()}-{w}-{d(1)}"])
        if name == "date":
            day, year = r.randint(1, 28), r.randint(1995, 2029)
            return r.choice([f"{day} {r.choice(MONTH)} {year}", f"{r.choice(MONTH)} {day}, {year}", f"{year}-{r.randint(1, 12):02d}-{day:02d}"])
        if name == "ddate":
            return f"{r.randint(1, 28)}.{r.randint(1, 12):02d}.{r.randint(1995, 2029)}"
        if name == "stamp":
            day, hour = r.randint(1, 28), r.randint(0, 23)
            return r.choice([f"2023-{r.randint(1, 12):02d}-{day:02d} {hour:02d}:{d(1)}1:{d(1)}2", f"{day:02d}/{r.randint(1, 12):02d}/2022 {hour:02d}:15", f"[2021-05-{day:02d}T{hour:02d}:10:00Z]", f"{r.choice(MONTH)[:3]} {day:2d} {hour:02d}:10:00"])
        if name == "ip":
            return ".".join(str(r.randint(1, 250)) for _ in range(4)) + r.choice(["", "/24"])
        if name == "hex":
            return "".join(r.choice("0123456789abcdef") for _ in range(8))
        if name == "amount":
            n = r.randint(100, 99999)
            return f"{n:,}" if r.random() < 0.4 else str(n)
        if name.startswith("digits"):
            return d(int(name[6:]))
        if name == "n2":
            return f"{r.randint(1, 12):02d}"
        return str(r.randint(1, 9) if name == "n1" else r.randint(1, 99))

    def fill(self, line: str) -> list[tuple[str, str | None]]:
        out: list[tuple[str, str | None]] = []
        number = ""
        line = line.replace("\\n", "\n")
        while "{" in line:
            head, _, rest = line.partition("{")
            name, _, line = rest.partition("}")
            out.append((head, None))
            if name == "id_label":
                label, number = self.id_pair()
                out.append((label, None))
            elif name == "id_number":
                out.append((number or self.id_pair()[1], "id_number"))
            elif name in ("person", "named"):
                out.append((getattr(self, name)(), "person"))
            elif name in ("email", "phone", "address"):
                out.append((getattr(self, name)(), name))
            elif name == "family":
                out.append((self.family(), "person"))
            else:
                out.append((self.filler(name), None))
        out.append((line, None))
        return [p for p in out if p[0]]


def labelled_texts(copies: int = 16, loose: int = 130, seed: int = 11) -> list[list[tuple[str, str | None]]]:
    """Texts of one to three lines of the table, as pieces (text, kind or None); copies and loose bound its size."""
    maker = Maker(seed)
    lines = [line for line in LINES for _ in range(copies)] + [line for line in LOOSE for _ in range(loose)]
    maker.r.shuffle(lines)
    out: list[list[tuple[str, str | None]]] = []
    while lines:
        text: list[tuple[str, str | None]] = []
        for _ in range(min(len(lines), maker.r.randint(1, 3))):
            if text:
                text.append((maker.r.choice([" ", " ", "\n", "\n\n"]), None))
            text += maker.fill(lines.pop())
        out.append(text)
    return out
