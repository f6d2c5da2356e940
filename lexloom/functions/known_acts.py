"""Documents whose title and names are known, and the terms that tell of them. The first that matches counts."""

# --- fixed values: (title, names, terms) --------------------------------------------------------------------
KNOWN_ACTS = [
    ("Employment Act 1955", ["Employment Act 1955", "Akta Kerja 1955", "Act 265"], ["akta kerja 1955", "employment act 1955"]),
    ("Federal Constitution", ["Federal Constitution", "Constitution of Malaysia"], ["federal constitution"]),
    ("Perlembagaan Persekutuan", ["Perlembagaan Persekutuan"], ["perlembagaan persekutuan"]),
    ("Personal Data Protection Act 2010", ["Personal Data Protection Act 2010", "PDPA", "Act 709"], ["personal data protection act 2010", "pdpa"]),
    ("Personal Data Protection (Amendment) Act 2024", ["Personal Data Protection (Amendment) Act 2024", "PDPA Amendment Act 2024", "Act A1727"], ["act a1727", "personal data protection amendment act 2024"]),
    ("Employees Provident Fund Act 1991", ["Employees Provident Fund Act 1991", "EPF Act 1991", "Act 452"], ["employees provident fund act 1991", "empoyees provident fund act 1991", "act 452"]),
    ("Minimum Wages Order 2024", ["Minimum Wages Order 2024", "Perintah Gaji Minimum 2024", "P.U. (A) 376"], ["minimum wages order 2024", "perintah gaji minimum 2024", "p u a 376", "pua 376"]),
    ("Factories and Machinery Act 1967", ["Factories and Machinery Act 1967", "Act 139"], ["factories and machinery act 1967", "act 139"]),
    ("Sale of Goods Act 1957", ["Sale of Goods Act 1957", "Act 382"], ["sale of goods act 1957", "act 382"]),
    ("Employment Insurance System Act 2017", ["Employment Insurance System Act 2017", "Act 800"], ["employment insurance system act 2017", "act 800"]),
    ("Consumer Protection Act 1999", ["Consumer Protection Act 1999", "Act 599"], ["consumer protection act 1999", "act 599"]),
    ("National Land Code", ["National Land Code", "Act 828"], ["national land code", "act 828"]),
    ("Penal Code", ["Penal Code", "Act 574", "Akta 574"], ["penal code", "act 574", "akta 574"]),
    ("Industrial Relations Act 1967", ["Industrial Relations Act 1967", "Act 177"], ["industrial relations act 1967", "act 177"]),
    ("Police Act 1967", ["Police Act 1967", "Act 344"], ["police act 1967", "act 344"]),
    ("Civil Law Act 1956", ["Civil Law Act 1956", "Act 67"], ["civil law act 1956", "act 67"]),
    ("Contracts Act 1950", ["Contracts Act 1950", "Act 136"], ["contracts act 1950", "act 136"]),
    ("Income Tax Act 1967", ["Income Tax Act 1967", "Act 53"], ["income tax act 1967", "act 53"]),
    ("Occupational Safety and Health Act 1994", ["Occupational Safety and Health Act 1994", "Act 514", "OSHA 1994"], ["occupational safety and health act 1994", "act 514"]),
    ("Road Transport Act 1987", ["Road Transport Act 1987", "Act 333"], ["road transport act 1987", "act 333"]),
    ("Holidays Act 1951", ["Holidays Act 1951", "Act 369"], ["holidays act 1951", "act 369"]),
    ("Law Reform (Marriage and Divorce) Act 1976", ["Law Reform (Marriage and Divorce) Act 1976", "Act 164"], ["law reform marriage and divorce act 1976", "law reform marriage and divorce", "act 164"]),
    ("Children and Young Persons (Employment) Act 1966", ["Children and Young Persons (Employment) Act 1966", "Act 350"], ["children and young persons employment act 1966", "act 350"]),
]
