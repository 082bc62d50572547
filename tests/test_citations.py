"""Forms of citations, and numbers that are none; inputs of our own."""

import random
import time

import pytest

from lexaudit.operators.citations import spans
from lexaudit.operators.spans import keep_longest


def found(text):
    return [text[a:b] for a, b in keep_longest(spans(text))]


@pytest.mark.parametrize(
    "text",
    [
        "HC 412.907/MG", "RE 870.947/SE", "ADI 4.277", "MS 25.888/DF", "AREsp 1.998.776/CE", "Pet 7.001/DF", "EDcl no AgInt no Recurso Especial nº 1.704.520 - MT",
        "Agravo Regimental na Suspensão\nde Segurança e de Liminar nº 3.905/PI", "Recl. n° 7G.402/ AM", "Recurso Especial nº l795581/GO", "Recurso Especial nº  l4478O2/ RN",
        "Recurso Especial n° 1.802-.517-SC", "processo nº TST-AIRR-10300-22.2011.5.02.0071", "Rcl 9",
    ],
)
def test_whole_numbered_cases(text):
    assert found(text) == ([] if text == "Rcl 9" else [text])


@pytest.mark.parametrize(
    "text",
    [
        "Súmula 150 do STF", "Súmula Vinculante 37", "SÚMULA 7 DO STJ", "5úmula 291 do TST", "Sum. 12", "Tema 999 dos recursos repetitivos", "Temã 3.104 da repercussão geral",
        "art. 489, II, do CPC", "art. 8º, § 2º, da Lei 9.099/1995", "art. 21 da Lei n.º 7.347/1985", "art. 73, § 10, da Lei no 9.504/97", "art. 2º da LC nº 95/98", "artigo 5º, I, 'c', da LC-75/1993",
        "art. 41 do Decreto-Lei nº 2.848/1940", "art. 9º do Decreto-lei 406", "art. 6º do Decreto- Lei 3.365/41", "art. 30 do Decreto n.º 70.235/72", "art. 22 da Lei Complementar nº 123/2006",
        "art. 17, do Decreto 3.048/99", "artigo 1 029 do CPC", "art. 1 228 do Código Civil", "art. 1.015 do CPC", "Artigo 7º, XIII, da Constituição Federal",
    ],
)
def test_whole_summaries_topics_and_articles(text):
    assert text in found(f"Assim, {text}.")


@pytest.mark.parametrize(
    "text",
    [
        "julgado do STJ proferido em 2016 pela relatoria de Nancy Andrade", "precedente do TSE de 2019, da relatoria de Pedro Paulo", "acórdão do STF julgado em 2011 sob relatoria de Carlos Brito",
        "Reclamação do STJ, de 2022, Rel. Min. HUMBERTO MARTA", "Rcl de 2017, Rel. Min. Laura Vazques", "decisão do TST de 2014, Rel. Min. Lelio Bento", "entendimento firmado pelo STF em 2009",
        "jurisprudência do STM consolidada em 2013", "precedente da Corte Especial do STJ de 2012", "acórdão da Terceira Turma do STJ, de 2018, Rel. Min. Paulo Tarso", "orientação jurisprudencial do TST de 2008",
        "AgRg de 2015, Rel. Min. Jorge Mussi", "julgado do TRT 3 de 2020", "precedente do TRF4 de 2016, Rel. Des. Marga", "julgado do STF profcrido em 2012 pela relatoria de CELSO\nMELLO",
        "acórdão do TSE julgadc em 2018 sob relatoria de Tarcisio Vieira", "acórdão do TRT da 15ª Região de 2021", "reiterados acórdãos do TRF da 1ª Região de 2010", "Agravo em Recurso do TJRS, de 2019, Rel. Des. Anita",
        "acórdão do Tribunal de Justiça do Rio de Janeiro de 2014", "aresto do Superior Tribunal de Justiça de 2005, relatado pelo Min. José D. Souza", "Habeas Corpus do STF, de 1998, Relator Ministro Moreira",
    ],
)
def test_whole_rulings(text):
    assert found(f"conforme {text}. Além disso") == [text]


@pytest.mark.parametrize(
    "text",
    [
        "DO7", "DA C0", "Arquive-se. Cumpra-se.\n\n3", "CNPJ 09.876.543/0001-21", "o CPF 987.654.321-00", "O Protocolo nº 2019.5512307 consta", "inscrito na OAB/PR 31855 assina", "na Portaria 4.321/2018",
        "o Decreto 6.514/2008", "matrícula nº 67890", "fixada em R$ 45.310,77.", "DJe de 9/11/2021", "Publicado no DJe em 7/8/2013", "DEJT 14/05/2010", "DJ de 1/9/1997", "Consta do Evento 23", "ID 77341029",
        "Segundo fls. 88", "o doc. 31 juntado", "mov. 12 dos autos", "O prazo de 30 dias corridos", "A multa de 10% incide", "Julgado em 12 de maio, com juros de 6% ao ano", "A redução de 25% da pena",
        "Pessoa com idade de 70 anos", "Turma composta de 3 membros", "Acórdão de 2021, sem mais", "Sessão de 04/10/2022.", "Publicado em 11/02/2020.", "Desconto de 1/6 da pena.", "Item 7.3 do edital.",
        "Cláusula 11 do contrato.", "Emenda Constitucional 103.", "Medida Provisória 1.045.", "Instrução Normativa 1.515/2014", "Projeto de Lei 3.267", "Nota Fiscal 20.331",
        "reiterados acórdãos do Supremo Tribunal Federal", "a jurisprudência pacífica daquela Corte", "o artigo pertinente do Código Penal", "a orientação dos tribunais é firme",
        "A matéria é de simples solução.",
    ],
)
def test_what_is_no_citation(text):
    assert found(text) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Rcl 33221/GO, Rel. Min. Sicrano, DJe de 8/4/2019", "Rcl 33221/GO"),
        ("AgInt no AREsp 554433/SC (DEJT 11/10/2013)", "AgInt no AREsp 554433/SC"),
        ("A Reclamação nº 40.208/PE", "Reclamação nº 40.208/PE"),
        ("Os EDcl no REsp 1.010.203/MS", "EDcl no REsp 1.010.203/MS"),
        ("Consoante Rcl 5511/DF, a tese", "Rcl 5511/DF"),
        ("Anote-se RE 4321/PR como marco", "RE 4321/PR"),
        ("Certamente HC 765/AL se aplica", "HC 765/AL"),
        ("Todavia AI 45/MT foi rejeitado", "AI 45/MT"),
        ("Também na Reclamação nº 21.004/RJ, a Corte", "Reclamação nº 21.004/RJ"),
        ("Cito o RE 5678/SP.", "RE 5678/SP"),
        ("art 9 da Lei nº 12.016/2009. O", "art 9 da Lei nº 12.016/2009"),
        ("Rcl de 2018, Rel. Min. ROSA LÚCIA.\n\nII", "Rcl de 2018, Rel. Min. ROSA LÚCIA"),
        ("Reclamação do STF, de 2013, Rel. Min. Ayres De Brito. Depois", "Reclamação do STF, de 2013, Rel. Min. Ayres De Brito"),
    ],
)
def test_where_a_citation_starts_and_ends(text, want):
    assert found(text) == [want]


def test_noun_before_a_summary():
    assert found("Reforça tal entendimento a Súmula 610\ndo STF, que") == ["Súmula 610\ndo STF"]


@pytest.mark.parametrize("piece", ["Recurso ", "A1 ", "1.", "oO", "O.", "1 ", "n 1", "Agravo do STF ", "acórdão do ", "art. 1 105, a", "Tema 1 ", "de 2020, Rel. ", "R.", "1o"])
def test_time_follows_length(piece):
    def took(n):
        text = piece * n
        began = time.perf_counter()
        list(spans(text))
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 12


def brute(spans):
    out = []
    for start, end in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        for a, b in out:
            both = max(0, min(end, b) - max(start, a))
            iou = both / (end - start + b - a - both) if both else 0
            if iou >= 0.5 or (start >= a and end <= b) or (a >= start and b <= end):
                break
        else:
            out.append((start, end))
    return sorted(out)


def test_longest_spans_stay():
    rng = random.Random(1)
    for _ in range(300):
        given = [(a := rng.randrange(60), a + rng.randrange(0, 30)) for _ in range(rng.randrange(40))]
        assert keep_longest(given) == brute(given)
    began = time.perf_counter()
    keep_longest([(i * 7, i * 7 + 4 + i % 11) for i in range(8000)])
    assert time.perf_counter() - began < 1
