"""Synthetic workbooks and documents for tests."""

import zipfile
from xml.sax.saxutils import escape

from rostra.sources.ooxml import write_workbook

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def workbook(path, **sheets):
    write_workbook(str(path), [(name.replace("_", " "), [[(str(c), "") for c in row] for row in rows], 0) for name, rows in sheets.items()])
    return str(path)


def column(*lines):
    return [[x] for x in lines]


def document(path, body, styles=(("ListParagraph", "List Paragraph"), ("Titre1", "heading 1"))):
    """body: (style id, text) paragraphs and lists of rows (tables)."""
    parts = []
    for x in body:
        if isinstance(x, list):
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in x)
            parts.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            style = f'<w:pPr><w:pStyle w:val="{x[0]}"/></w:pPr>' if x[0] else ""
            parts.append(f"<w:p>{style}<w:r><w:t xml:space='preserve'>{escape(x[1])}</w:t></w:r></w:p>")
    named = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in styles)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(parts)}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>{named}</w:styles>')
    return str(path)


def network(path):
    lyon = column(
        "LYON", "", "Centre de référence", "Responsable : Pr DUPONT Alain", "Adresse postale : 1 rue A\n69000 Lyon", "",
        "1.   NEPHROLOGUES", "Secteur Pédiatrie :", "NOM – PRENOM : BERNARD Sophie", "Hôpital de rattachement : Hôpital Mère-Enfant", "Adresse postale : 2 rue B", "Téléphone : 04 72 00 00 01", "Adresse mail : sophie@chu.fr",
        "Secteur Adulte :", "NOM – PRENOM : PETIT Marc", "Téléphone : +33 4 72 00 00 02",
        "2. DERMATOLOGUES", "Secteur Pédiatrie :", "NOM – PRENOM : DURAND Claire", "Hôpital de rattachement : CHU Lyon", "Secteur Adulte :", "NOM – PRENOM : idem pédiatrie",
        "3. AUTRES SPECIALITES, préciser : Neurologie pédiatrique", "NOM – PRENOM : Pr LEROY Thomas & MOREAU Julie",
    )
    strasbourg = column("STRASBOURG", "Centre de compétence", "Responsable : X", "4. CARDIOLOGUES", "NOM – PRENOM : pas de référent", "Nefrologie", "NOM – PRENOM : KLEIN Eva ou collègue")
    lille = column("LILLE", "Centre de compétence", "Note", "Autre", "Dr Lambert Paul, dermatologue", "contact lambert@chu.fr", "pédiatre et adulte")
    return workbook(path, Lyon=lyon, Strasbourg=strasbourg, Lille=lille)


def care(path):
    p = "ListParagraph"
    return document(path, [
        ("", "Introduction"), (p, "CHU de Grenoble"), ("", "Dr Francois GARCIA (dermatologue)"), ("", "Service de dermatologie"), ("", "Tél. secrétariat : 04 76 00 00 01"), ("", "garcia@chu.fr"),
        (p, "CHU de Lyon"), ("", "Pr Claire DURAND et Dr Nicolas FAURE"), ("", "Prise en charge enfants et adultes"), ("", "Tél : 04 72 11 11 11"),
        (p, "CHU de Clermont-Ferrand"), ("", "Dr Anne Thomas, neurologue"),
    ])
