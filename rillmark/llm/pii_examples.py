"""Labelled training texts: annotated sentences by hand, filled with invented values."""

from __future__ import annotations

import random
import re

# Annotated sentences by kind of text. {name}, {name_hi}, {email}, {phone}, {id}, {id_...} and {address} are personal
# data; other slots ({place}, {org}, {date}, ...) are not. The kind "notices" was written after reading sample
# documents, the others without them; the tests hold out whole kinds.
TEXT_KINDS = {
    "notices": (
    "Contact person - {name}, tel {phone}, {email}.",
    "District officer {name} ({email}) will hear appeals at {place}.",
    "The applicant, {name}, may be reached on {phone} after noon.",
    "My father {name} lives at {address} and has no bank account.",
    "My mother {name} lives at {address}.",
    "I, {name}, resident of {address}, state that my claim was forwarded.",
    "Name: {name}\nMobile: {phone}\nE-mail: {email}",
    "Claimant: {name} | Ph: {phone} | {email}",
    "Claimant: {name} | Ph: {phone}",
    "Copy to: {title} {name}, {address}",
    "Her {label} {id} was typed wrongly, and {title} {name} asked for a new card.",
    "Son of the late {name}, the boy of {place} holds {label} {id} and lives at {address}.",
    "Nominee {name} ({label} {id}), relation: daughter.",
    "Verified against {label} {id} and {label} {id} on {date}.",
    "The record with {label} {id} belongs to another person in {place}.",
    "{title} {name} of {place} said the instalment of {rs} never came.",
    "{name} and {name} signed the muster roll of {place} twice.",
    "Present in {place}: {name}, {name} and {name}; minutes by {name}.",
    "Yours faithfully,\n{name}\n{phone}",
    "Sincerely,\n{name}\n{phone}",
    "{n3} villages around {place} joined the {stem} {theme} {kind} to settle old dues.",
    "Call {phone} or {phone} to book a visit in {place}.",
    "WhatsApp {phone} for the list of loom parts.",
    "Reply at {email} or come to {address} with two photographs.",
    "For corrections write to {email} before {date}.",
    "Mail id {email}; no reply since {date}.",
    "Please send the order to {address}.",
    "दूरभाष: {phone} पर संपर्क करें।",
    "संपर्क: {name}, {phone}।",
    "Application ref. {n4} {n4} {n4} is still open at {place}.",
    "Application no. {n12} was returned to {place} on {date}.",
    "The transaction {n10} was credited on time.",
    "Transaction id {n12} failed twice.",
    "Tender {panlike}/{n2} closes on {date}.",
    "Budget head {n4}-{n2}-{n3} carries {rs}.",
    "File {n4}-{n4}-{n4} was moved to {place}.",
    "Toll-free line 1800-{n3}-{n4} is open from 9 to 5.",
    "Follow @{handle}_{lowplace} for notices.",
    "See https://portal.{domain}/forms/{n3} for the form.",
    "Loans @ {n2}.5 per cent are on offer in {place}.",
    "The {family} Memorial {theme} Fund pays {rs} a year.",
    "The {name_plain} Memorial {theme} Fund pays {rs} a year.",
    "The {family} {theme} Yojana closes on {date}.",
    "Under the {stem} {theme} {kind}, weavers in {place} receive {rs} on time.",
    "Beneficiaries of {stem} {theme} {kind} at {place} opened {n2},{n3} accounts, and {n3} were cleared for want of the birth record.",
    "The Ministry of Small Trades renewed the {stem} {theme} {kind} up to {month} 2018-19 with an outlay of {rs}.",
    "Ward {n3} of {place} reported late sanction orders; the treasury recorded the matter on {date}.",
    "Order {AA}/{n4}/{n2} asks the gram sabha to settle {n2} pending cases from {place} before {date}.",
    "Letter {AA}/{n4}/{n2} of the Department of Village Works fixes the rate for text books at {rs} from {date}.",
    "Bills under head {AA}/{n4}/{n2} rose from {rs} in 2013-14 to {rs} a year later.",
    "A sum of {rs} was released to {place} by the Department of Minor Irrigation, of which {rs} stayed unspent.",
    "Field notes from {place} and {place} mention poor road access as well as {n3} idle solar pumps.",
    "Penalty of {rs} applies if cold boxes are sold outside {place} within {n3} months.",
    "Street vendors, weavers with a pass book and retired miners come first on the waiting list of {place}, which holds {n2},{n3} names.",
    "If {alien} objects, {alien} {theme} hears the case again within {n3} weeks and tells {alien}.",
    "Only rural youth listed by {alien} {theme} qualify, unless {alien} grants a waiver of {rs}.",
    "Not every {alien} {theme} office and no {alien} desk keeps a register.",
    "{stem} {theme} {kind} के अंतर्गत छात्र समय पर ऋण पा सकते हैं। {place} पंचायत में {n3} महिला का भत्ता स्वीकृत हुआ।",
    "आदेश {AA}/{n4}/{n2} के अनुसार समिति परिवार के बीज को स्वीकृत करे।",
    "No fee is due to apply; the ward office in {place} issues slip {AA}/{n4}/{n2} after field checks.",
    "A sum of {rs} was released to {place} by the Department of {topic}, of which {rs} stayed unspent.",
    "Ward {n2}, Sector {n2} of {place} got {n3} record forms.",
    "A grant from {alien} {theme} covers {n2} per cent, and {alien} {theme} keeps the list.",
    "The Ministry of {topic} and the {topic} cell reported to {place}.",
    "By {date}, the {place} {topic} Unit had sanctioned {n2},{n3} forms.",
    "Stocks fell at 3050 rupees from {date}. By {date}, the treasury had returned {n3}.",
    "The helpline of {place} took {n2},{n3} calls in 2014-15, and 5.1 per cent concerned flooded godowns.",
    ),
    "parcels": (
        "By {date}, the {topic} team had cleared {n3} parcels.",
        "Dispatch note of {date} was seen by {topic} staff at {org}.",
        "Deliver to: {name}, {address}. Ring {phone} on arrival.",
        "Parcel {AA}{n7} left {place} hub at {n2}:{n2}; the consignee is {name}.",
        "Return undelivered items to {address}",
        "Tracking number {n12} shows two failed attempts at {place}.",
        "Receiver {name} signed; alternate contact {phone}",
        "Carton {n3} of {n3}, weight {n2} kg, booked by {org}.",
        "Pickup from {address} between 9 and 11; ask for {name}.",
        "Freight bill {n10} was settled by {org} on {date}.",
    ),
    "clinic": (
        "The {topic} Camp runs from {date} to {date} at {org}.",
        "Ask at the {topic} counter before {date}.",
        "Patient {name}, aged {n2}, was seen on {date} for a cough.",
        "Next of kin: {name} ({phone}).",
        "{title} {name} advised rest; the report goes to {email}.",
        "Lab sample {n8} was sent to {org} in {place}.",
        "Patient lives at {address} and came by bus.",
        "Identity proof: {label} {id}, copied by the desk.",
        "Blood Pressure {n3}/{n2}, Heart Rate {n2}, Body Temperature 98.{n2}.",
        "Bed {n2} in Ward {n2} is free after {name} leaves.",
        "Ring our clerk on {phone} to shift the visit.",
        "Health Card number {n10} belongs to the clinic, not to a person.",
    ),
    "school": (
        "Subjects: {topic}, {topic} and Moral Science.",
        "Holidays begin on {date} as told by the {topic} Office.",
        "Roll no. {n2}: {name}, daughter of {name}.",
        "Guardian {name} may be rung at {phone} in school hours.",
        "The class teacher, {name}, wrote to {email} twice.",
        "Admission register {n4}/{n2} has {n3} entries for {place}.",
        "The bus stops near {address} at seven.",
        "Sports Day and Science Fair fall in {month}; {name} will open both.",
        "{name} came first in Social Science and {name} in Modern History.",
        "Identity number {id_aadhaar} was written on the form of {name}.",
        "Certificate no. {n6} was issued by {org}.",
    ),
    "bank": (
        "Our {topic} Loan and {topic} Card open on {date}.",
        "Statement Date {date}, Due Date {date}.",
        "Account {n11} was opened by {name} with {label} {id}.",
        "KYC: {name} | {label} {id} | {phone} | {email}",
        "Mailing address of the borrower: {address}",
        "Cheque {n6} for {rs} was returned on {date}.",
        "IFSC ABCD0{n6}, branch {place}, Savings Account {n12}.",
        "UTR {n12} credited {rs} to the Loan Account of {org}.",
        "The guarantor {name} holds {label} {id}.",
        "For a lost card call {phone} at any hour; write to {email} for statements.",
        "Dear {name}, your Fixed Deposit of {rs} matures in {month}.",
        "Customer ID {n8} and Deposit Receipt {n9} must be quoted.",
    ),
    "police": (
        "The {topic} Squad and the Traffic Branch left at {n2}:{n2} on {date}.",
        "Complainant {name} s/o {name}, r/o {address}, appeared at the station.",
        "FIR {n4}/20{n2} was lodged by {title} {name}.",
        "The vehicle was driven by {name}, licence {id_dl}.",
        "Witness no. {n2}, {name}, gave the number {phone}.",
        "Sub Inspector {name} searched the Old Market with two Home Guards.",
        "Stolen: a phone, a wallet with {label} {id}, and {rs}.",
        "Section {n3} of the Penal Code and Rule {n2} of the Motor Vehicles Act apply.",
        "The accused gave a false address, {address}, and ran.",
        "Case Diary {n4}, page {n2}, names no one.",
    ),
    "hiring": (
        "Skills: {topic}, {topic}. Certified in {topic} on {date}.",
        "The {topic} Manager of {org} will reply by {date}.",
        "{name}\n{address}\n{phone} | {email}\nSenior Accounts Clerk",
        "Referee: {name}, Head of Operations, {org}, {email}",
        "{name} joined {org} as Data Entry Operator in {month} 20{n2}.",
        "Employee code {n6} was given to {name}.",
        "Interview on {date} at {org}, {place}; bring {label} {id}.",
        "Computer Skills: Word Processing, Spread Sheets. Driving Test passed in 20{n2}.",
        "Human Resources may be reached by {name} on {phone}.",
        "Offer letter {AA}/{n4} lapses after {n2} days.",
    ),
    "chat": (
        "{topic} is closed till {date} says the board at {place}",
        "hi this is {name}, my number is {phone}, pls call back",
        "ok so mail it to {email} and cc {email}",
        "am at {address} now, gate is blue",
        "lol {name} forgot the {n2} tickets again",
        "my order {n10} is late since {date}",
        "which doc u need? my {label} is {id}",
        "meet {name} near Central Park at {n2}:{n2}, she has {rs}",
        "use code SAVE{n2} on www.{domain}/offer, follow @{handle}",
        "New Year sale at {org} starts Monday Morning",
    ),
    "court": (
        "The {topic} Act and the {topic} Rules were read on {date}.",
        "{name} versus {name}, decided on {date}.",
        "Heard {title} {name} for the appellant and {name} for the State.",
        "Notice was served at {address} by the bailiff.",
        "Civil Appeal No. {n4} of 20{n2} is dismissed with costs of {rs}.",
        "Before Justice {name}: Order dated {date}.",
        "The plaintiff, {name}, relied on Exhibit {n2} and on {label} {id}.",
        "High Court and District Court records from {place} were called for.",
        "Advocate {name} may be served at {email}.",
    ),
    "housing": (
        "The {topic} Authority approved Green Meadows Phase {n2} on {date}.",
        "Tenant {name} pays {rs} for {address}.",
        "For rent: two rooms at {address}; owner {name}, {phone}.",
        "Site visit booked with {name} of {org}.",
        "The Green Valley and Silver Oak blocks of {org} are full.",
        "Electricity meter {n9} reads {n5} units.",
        "Lease signed by {name} and {name} before {name}, notary.",
        "Send rent slips to {email} or {address}",
        "Survey number {n3}/{n2}, Khata {n4}, measures {n3} square feet.",
    ),
    "travel": (
        "The {topic} Counter at {place} Junction opens on {date}.",
        "Passenger {name}, passport {id_passport}, seat {n2}A.",
        "PNR {n10}, coach S{n2}, berth {n2}, {place} to {place}.",
        "Emergency contact: {name}, {phone}.",
        "Booking made by {name} through {email}",
        "The Night Express leaves Platform {n2} for {place}.",
        "Hotel Blue Lagoon holds a room for {name} until {date}.",
        "Visa of {name} ({label} {id}) was stamped at {place}.",
        "Flight {AA} {n3} of {org} was late by {n2} minutes.",
        "Ticket {n12} cannot be refunded. Helpline 1800 {n3} {n4}.",
    ),
    "news": (
        "The {topic} Bill was passed on {date}; the {topic} Minister left early.",
        "A study by the Centre for {topic} found little change at {place}.",
        "{name} told reporters that prices in {place} rose by {n2} per cent.",
        "The award went to {name}, {n2}, a weaver from {place}.",
        "\"We waited {n2} hours,\" said {name}.",
        "Chief Minister {name} opened the New Bridge at {place} on {date}.",
        "South Zone beat North Zone after {name} scored {n2}.",
        "{name} and {name} wrote the report for {org}.",
        "Prime Time News and World Report carried the story from {place}.",
        "The State Bank and the Health Ministry gave no comment.",
        "After the flood {name} moved in with {name} near {place}.",
    ),
    "insurance": (
        "The {topic} Cover starts on {date}, as the {topic} Desk has said.",
        "Policy {n9} covers {name} and nominee {name}.",
        "Claim {AA}{n8} was filed from {address}.",
        "Surveyor {name} can be reached on {phone} or {email}.",
        "Proof of age: {label} {id}.",
        "Vehicle ABC {n4}, engine {n8}, insured with {org}.",
        "Claim reference {n12} was closed on {date} for {rs}.",
        "Insured person: {name}\nResidence: {address}\nTelephone: {phone}",
        "Terms of the Golden Harvest plan and the Family Shield plan differ.",
    ),
    "hindi": (
        "आवेदक {name_hi} का पता: {place}, {date} को जाँच हुई।",
        "श्री {name_hi} ने {phone} पर बात की।",
        "नाम: {name_hi}, फोन: {phone}, ईमेल: {email}",
        "श्रीमती {name_hi} को {rs} मिले।",
        "पिता {name_hi} और माता {name_hi} गाँव में रहते हैं।",
        "{name_hi} ने आवेदन {n10} जमा किया।",
        "आधार संख्या {id_aadhaar} गलत लिखी गई।",
        "पत्र {address} पर भेजें।",
        "योजना की रसीद {n12} और फाइल {n4}/{n2} देखें।",
        "ग्राम सभा ने {n3} परिवारों को राशि दी और बैठक {date} को रखी।",
        "Contact {name}, {phone}, कार्यालय समय में।",
    ),
}
#: Public given and family names that are in wide use, as fixed values; the known names of a call come on top.
PUBLIC_GIVEN = (
    "Suresh Ramesh Rajesh Mahesh Anil Sunil Vijay Sanjay Amit Rohit Arjun Kiran Deepak Manoj Ashok Ravi Mohan Gopal Vikram Rahul Priya Sunita Anita Kavita Lakshmi Meena Geeta Sita Radha Pooja "
    "Neha Asha Usha Rekha Shanti Fatima Ayesha Imran Salman Yusuf Mohammed Ahmed Abdul Harpreet Gurpreet Joseph Thomas George Mary Anna John Peter Paul David Michael James Robert Sarah Emma Maria Carlos Elena Chen Wei Olga Ivan Aisha"
).split()
PUBLIC_FAMILY = (
    "Sharma Verma Gupta Singh Kumar Patel Shah Mehta Iyer Iyengar Nair Menon Pillai Reddy Rao Naidu Das Bose Ghosh Banerjee Mukherjee Chatterjee Sen Dutta Roy Jain Agarwal Mishra Tiwari Pandey Yadav Chauhan Thakur Joshi Desai "
    "Kulkarni Deshmukh Patil Khan Ansari Qureshi Sheikh Begum Kaur Gill Sandhu Fernandes Dsouza Pinto Smith Johnson Brown Miller Garcia Martinez Lopez Wang Li Petrov Novak Silva Costa Murray"
).split()
PUBLIC_HINDI = (
    "राम श्याम सुरेश रमेश महेश अनिल सुनील विजय संजय अमित मोहन गोपाल सीता गीता राधा सुनीता अनीता कविता लक्ष्मी मीना प्रसाद शर्मा वर्मा गुप्ता सिंह कुमार पटेल यादव मिश्रा तिवारी पांडे चौहान ठाकुर जोशी देवी लाल खान अंसारी कौर"
).split()
ORGANISATIONS = (
    "Blue River", "Sunrise Public", "National Textile", "Eastern Grain", "Metro Rail", "Lotus Medical", "Star General", "United Farmers", "Silver Line", "Hill Top", "Coastal Fisheries", "Modern Tools",
)
#: Words of offices, topics and headings, for capitalised pairs that are no names.
TOPIC_WORDS = (
    "Village Works Minor Irrigation Household Credit Cooperative Stores Benefit Delivery Nutrition Supply Rural Housing Small Trades Labour Welfare Food Safety Public Health Water Resources Social Justice Skill Training Market Reform "
    "Urban Transport Forest Produce Land Records Child Care Power Supply Farm Input Data Centre Price Control Tax Relief Grain Storage Road Repair Fish Seed Milk Union Loan Recovery Field Survey Annual Report Quality Control Digital Service Final Notice"
).split()
ORGANISATION_KINDS = ("Logistics", "School", "Hospital", "Bank", "Traders", "Corporation", "Insurance Company", "Housing Society", "College", "Mills", "Airlines", "Press")
# Endings of personal names are shared with the lexicon at run time; these are for places and schemes.
PLACE_ENDS = ("pur", "nagar", "gaon", "heda", "kota", "bad", "mar", "vana", "thal", "wadi", "ra", "garh")
STEMS = ("Ban", "Dhol", "Kari", "Mund", "Sor", "Tilu", "Chak", "Ram", "Gond", "Pal", "Jhal", "Vir", "Nand", "Lohi", "Kher", "Sund", "Birm", "Hast", "Moli", "Ojh")
THEMES = ("Jal", "Awas", "Kisan", "Urja", "Setu", "Mahila", "Van", "Poshan", "Yuva", "Matsya", "Gram", "Rozgar", "Shiksha", "Swasthya", "Bunkar", "Sadak")
KINDS = ("Yojana", "Scheme", "Mission", "Fund", "Abhiyan", "Programme", "Initiative")
LABELS = ("Aadhaar no.", "Aadhaar:", "Aadhaar", "aadhar number", "UID", "UID No", "PAN", "PAN no.", "PAN:", "pan card", "EPIC no.", "voter ID:", "voter card", "passport", "Passport No.", "passport number", "DL no.", "driving licence", "licence number", "identity number", "identity card no.", "ID no.", "Aadhaar card no.", "Voter ID no.")
TITLES = ("Mr.", "Ms", "Smt.", "Shri", "Dr.", "Prof.", "Kumari", "Mrs.")
STREETS = ("Gali", "Marg", "Street", "Road", "Cross", "Lane")
MONTHS = ("January", "March", "May", "July", "August", "October", "December")


class Filler:
    """Invented values from a seeded generator; names mix known tokens with unknown ones of like form."""

    def __init__(self, rng: random.Random, given: list[str], family: list[str]) -> None:
        self.r, self.given, self.family = rng, given or ["Anaya", "Kirti"], family or ["Sonekar", "Vardhan"]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def token(self, known: list[str], kind: str) -> str:
        public = PUBLIC_GIVEN if kind == "given" else PUBLIC_FAMILY
        form = self.r.random()
        if form < 0.25:
            return self.r.choice(public)
        a, b = self.r.choice(known), self.r.choice(known)
        if form < 0.6:
            return a
        if form < 0.7:  # of no list and like none of its names
            return (self.syllables(2) if self.r.random() < 0.6 else self.syllables(3)).capitalize()
        k = self.r.randint(3, 5)
        return (a[:k] + b[-self.r.randint(3, 4) :]).capitalize()

    def syllables(self, n: int) -> str:
        r = self.r
        return "".join(r.choice("b bh ch d dh g h j k kh l m n p r s sh t th v y z w f".split()) + r.choice("a e i o u aa ee ai".split()) + r.choice(["", "", "n", "r", "l", "sh", "t", "m"]) for _ in range(n))

    def name_hi(self) -> str:
        return " ".join(self.r.sample(PUBLIC_HINDI, 2))

    def topic(self) -> str:
        return " ".join(self.r.sample(TOPIC_WORDS, self.r.choice((2, 2, 2, 3))))

    def org(self) -> str:
        return self.r.choice(ORGANISATIONS) + " " + self.r.choice(ORGANISATION_KINDS)

    def name(self) -> str:
        g, f = self.token(self.given, "given"), self.token(self.family, "family")
        if self.r.random() < 0.12:
            f += "-" + self.token(self.family, "family")
        initial = self.r.choice("ABCDHKLMPRST") + "."
        form = self.r.random()
        if form < 0.62:
            out = f"{g} {f}"
        elif form < 0.74:
            out = f"{g} {initial} {f}"
        elif form < 0.86:
            out = f"{g[0]}. {f}"
        else:
            out = f"{f.upper() if self.r.random() < 0.6 else f}, {g}"
        if "," not in out and self.r.random() < 0.12:
            out = out.upper()
        if self.r.random() < 0.04:
            out = out.replace(" ", "\n", 1)
        return out

    def place(self) -> str:
        return self.r.choice(STEMS) + self.r.choice(("", "i", "a", "u", "o", "er", "il")) + self.r.choice(PLACE_ENDS)

    def stem(self) -> str:
        if self.r.random() < 0.5:  # schemes may be named like persons
            return self.r.choice(STEMS) + self.r.choice(("", "i", "a", "e")) + self.r.choice(self.given)[-self.r.randint(2, 4) :]
        return self.r.choice(STEMS) + self.r.choice(("iti", "ala", "aya", "ini", "osh", "ana", "ik"))

    def alien(self) -> str:
        return self.r.choice(("Xan", "Ovv", "Wyth", "Phae", "Zhu", "Kny", "Quor", "Ezz", "Tho")) + self.r.choice(("irra", "elexis", "ulyx", "umba", "ophet", "andor", "ovia"))

    def domain(self) -> str:
        base = self.r.choice(("fen", "pin", "okra", "lum", "cob", "torl", "desk", "bri")) + self.r.choice(("net", "box", "wire", "mail", "post", "hive", "gate"))
        return self.r.choice(("", "", "mail.", "in.")) + base + "." + self.r.choice(("example", "test", "invalid"))

    def email(self) -> str:
        g, f = self.r.choice(self.given).lower(), self.r.choice(self.family).lower()
        local = self.r.choice((f"{g}.{f}", f"{g}{self.digits(2)}", f"{f}_{g[0]}", f"{g}-{f}", f"{g[0]}{f}", f"{g}+claims", f"desk{self.digits(2)}.{self.place().lower()}"))
        form, out = self.r.random(), f"{local}@{self.domain()}"
        if form < 0.12:
            out = out.replace("@", " [at] ").replace(".", " [dot] ")
        elif form < 0.24:
            out = out.replace(".", " dot ").replace("@", " at ")
        elif form < 0.34:
            out = out.replace("@", self.r.choice((" (at) ", "[at]", " @ ", "(at)")))
        return out.upper() if self.r.random() < 0.1 else out

    def phone(self) -> str:
        d = self.digits
        if self.r.random() < 0.3:
            head = self.r.choice("6789")
            return self.r.choice((f"{head}{d(9)}", f"{head}{d(4)} {d(5)}", f"+91 {head}{d(4)} {d(5)}", f"+91-{head}{d(9)}", f"0{d(2)}-{d(4)} {d(4)}", f"(0{d(2)}) {d(4)}-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+1 {d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{head}{d(2)} {d(3)} {d(4)}"))
        out = self.r.choice((f"+{d(3)} {d(5)} {d(5)}", f"+{d(3)}-{d(10)}", f"00{d(3)} {d(3)} {d(3)} {d(4)}", f"(0{d(3)}) {d(3)} {d(4)}", f"0{d(3)}-{d(7)}", f"{d(5)} {d(5)}", f"{d(5)}-{d(5)}", d(10), f"{d(3)}.{d(3)}.{d(4)}"))
        if self.r.random() < 0.06:
            out = out.translate({48 + i: 0x966 + i for i in range(10)})
        return out

    def id_of(self, label: str) -> str:
        d, low = self.digits, label.lower()
        letters = lambda n: "".join(self.r.choice("ABCDEFGHJKLMNPRSTVWXZ") for _ in range(n))
        if "aadh" in low or "uid" in low or "ident" in low or low.startswith("id "):
            sep = self.r.choice((" ", " ", "-", ".", ""))
            return sep.join((d(4), d(4), d(4)))
        if "pan" in low:
            return letters(5) + d(4) + letters(1)
        if "epic" in low or "voter" in low:
            return letters(3) + self.r.choice(("", "/")) + d(7)
        if "passport" in low:
            return letters(1) + d(7)
        return letters(2) + d(2) + self.r.choice((" ", " ", "-", "")) + "20" + d(9)

    def address(self) -> str:
        n, r = (lambda a, b: str(self.r.randint(a, b))), self.r
        street = r.choice(("Old", "Harr", "Sun", "Pello", "Imli", "Dov", "Keth", "Bhira")) + r.choice(("wick", "ford", "mere", "tal", "ley", "bagh", "ale")) + " " + r.choice(STREETS)
        place, pin = self.place(), self.digits(3) + r.choice((" ", "")) + self.digits(3)
        road = r.choice(("MG", "Station", "Temple", "Lake", "Park", "Gandhi", "Nehru", "College", "Church", "Canal", "Ring", "Hill", street.split()[0])) + " " + r.choice(("Road", "Street", "Lane", "Avenue", "Nagar", "Colony", "Extension", "Bazar", "Layout", "Marg"))
        house = r.choice(("Lake View", "Rose Garden", "Green Park", "Shanti", "Sai Krupa", "Palm Grove", "Sunrise", "Royal", street.split()[0])) + " " + r.choice(("Apartments", "Residency", "Villas", "House", "Heights", "Society", "Enclave", "Bhavan", "Complex"))
        if r.random() < 0.35:
            return r.choice(
                (
                    f"{n(1, 400)} {house}, {road}, {place} {pin}",
                    f"{n(1, 400)}, {house}, {road}, {place} - {pin}",
                    f"{n(1, 99)} {road}, {place}",
                    f"{n(1, 99)} {road}, {place} {pin}",
                    f"Apartment {n(1, 40)}{r.choice('ABCD')}, {house}, {road}, {place} {pin}",
                    f"No. {n(1, 300)}, {n(1, 9)}th Main, {road}, {place} - {pin}",
                    f"#{n(1, 300)}, {n(1, 9)}nd Cross, {road}, {place} {pin}",
                    f"Shop No. {n(1, 40)}, {road}, Near Bus Stand, {place}",
                    f"{n(1, 300)}-{n(1, 40)}-{n(1, 40)}, {road}, {place}, {pin}",
                    f"Door No. {n(1, 300)}, {road}, {place}, PIN {pin}",
                    f"Plot {n(1, 300)}, {road}, Phase {n(1, 3)}, {place} {pin}",
                    f"House No. {n(1, 300)}, Village {place}, Post {self.place()}, District {self.place()} {pin}",
                )
            )
        out = r.choice(
            (
                f"H. No. {n(1, 300)}/{n(1, 9)}, {street}, {place} - {pin}",
                f"{n(1, 300)}/{r.choice('ABCD')} {street}, P.O. {self.place()}, {place} {pin}",
                f"Flat {n(1, 20)}{r.choice('ABCD')}, {street.split()[0]} Towers, {n(2, 12)}th {r.choice(STREETS)}, {place} {pin}",
                f"House {n(1, 300)}, Ward {n(1, 30)}, {place}, PIN {pin}",
                f"Plot {n(1, 300)}, Sector {n(1, 40)}, {place}, District {self.place()}, {pin}",
                f"Door No. {n(1, 300)}-{n(1, 9)}-{n(1, 40)}, Near Old {street.split()[0]} Mill, Village {self.place()}, Tehsil {place}",
                f"{n(1, 300)} {street}, {place}",
            )
        )
        return out.replace(", ", ",\n") if r.random() < 0.25 else out


def labelled_texts(count: int, given: list[str], family: list[str], seed: int = 42, kinds: tuple[str, ...] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``count`` texts of one to five sentences with their labelled spans; the same for the same seed and names.

    Without ``kinds`` all are used, the first for a third of the texts; the sentences of one text are of one kind.
    """
    rng = random.Random(seed)
    f = Filler(rng, sorted(given), sorted(family))
    kinds = kinds or (*TEXT_KINDS, *[next(iter(TEXT_KINDS))] * (len(TEXT_KINDS) // 2))
    out = []
    for _ in range(count):
        text, spans = "", []
        sentences = TEXT_KINDS[rng.choice(kinds)]
        for _ in range(rng.randint(1, 5)):
            sentence = rng.choice(sentences)
            if rng.random() < 0.3:
                sentence = sentence.rstrip(".")
            case = rng.choice((str.upper, str.swapcase, str.title)) if rng.random() < 0.09 and not re.search(r"\{(?:name|id|email|phone|address)", sentence) else str
            if text:
                text += rng.choice((" ", " ", "\n", "\n\n"))
            label = ""
            while sentence:
                head, brace, sentence = sentence.partition("{")
                text += case(head)
                if not brace:
                    break
                slot, _, sentence = sentence.partition("}")
                if slot == "label":
                    label = value = rng.choice(LABELS)
                else:
                    value = _value(f, rng, slot, label)
                kind = "id_number" if slot.startswith("id") else slot.removesuffix("_hi")
                if kind in ("name", "email", "phone", "id_number", "address"):
                    spans.append((len(text), len(text) + len(value), kind))
                text += case(value)
        out.append((text, spans))
    return out


def _value(f: Filler, rng: random.Random, slot: str, label: str) -> str:
    if slot == "id":
        return f.id_of(label)
    if slot.startswith("id_"):
        return f.id_of(slot[3:])
    if slot in ("name", "name_hi", "org", "topic", "email", "phone", "address", "place", "stem", "alien", "domain"):
        return getattr(f, slot)()
    if slot[0] == "n" and slot[1:].isdigit():
        return f.digits(int(slot[1:]))
    if slot == "name_plain":
        return f"{rng.choice(f.given)} {rng.choice(f.family)}"
    return {
        "title": lambda: rng.choice(TITLES),
        "family": lambda: rng.choice(f.family),
        "lowplace": lambda: f.place().lower(),
        "handle": lambda: f.domain().split(".")[-2],
        "theme": lambda: rng.choice(THEMES),
        "kind": lambda: rng.choice(KINDS),
        "month": lambda: rng.choice(MONTHS),
        "date": lambda: rng.choice((f"{rng.randint(1, 31)} {rng.choice(MONTHS)} 20{f.digits(2)}", f"{rng.randint(1, 31):02d}{(sep := rng.choice('...-/'))}{rng.randint(1, 12):02d}{sep}20{f.digits(2)}")),
        "rs": lambda: rng.choice((f"Rs. {rng.randint(1, 45)},{rng.randint(1, 9)}50", f"Rs. {rng.randint(1, 45)}.{f.digits(2)} lakh", f"{rng.randint(500, 6000)} rupees")),
        "AA": lambda: rng.choice("ABDFGJKLMPST") + rng.choice("ABDFGJKLMPST"),
        "panlike": lambda: f.id_of("pan"),
    }[slot]()
