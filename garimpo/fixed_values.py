"""File formats, code lists and texts that results depend on.

Nothing here is logic. Column names, code lists and result texts stay in
Portuguese because they are the published file formats and the result values.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Company registry files (no header, order is the contract)
# ---------------------------------------------------------------------------

CSV_DELIMITER = ";"
CSV_QUOTE = '"'
CSV_ENCODING = "ISO-8859-1"

EMPRESAS = (
    "cnpj_basico",
    "razao_social",
    "natureza_juridica",
    "qualificacao_responsavel",
    "capital_social",
    "porte_empresa",
    "ente_federativo_responsavel",
)

ESTABELECIMENTOS = (
    "cnpj_basico",
    "cnpj_ordem",
    "cnpj_dv",
    "identificador_matriz_filial",
    "nome_fantasia",
    "situacao_cadastral",
    "data_situacao_cadastral",
    "motivo_situacao_cadastral",
    "nome_cidade_exterior",
    "pais",
    "data_inicio_atividade",
    "cnae_fiscal_principal",
    "cnae_fiscal_secundaria",
    "tipo_logradouro",
    "logradouro",
    "numero",
    "complemento",
    "bairro",
    "cep",
    "uf",
    "municipio",
    "ddd_1",
    "telefone_1",
    "ddd_2",
    "telefone_2",
    "ddd_fax",
    "fax",
    "correio_eletronico",
    "situacao_especial",
    "data_situacao_especial",
)

SOCIOS = (
    "cnpj_basico",
    "identificador_socio",
    "nome_socio_razao_social",
    "cpf_cnpj_socio",
    "qualificacao_socio",
    "data_entrada_sociedade",
    "pais",
    "representante_legal",
    "nome_do_representante",
    "qualificacao_representante_legal",
    "faixa_etaria",
)

SIMPLES = (
    "cnpj_basico",
    "opcao_pelo_simples",
    "data_opcao_simples",
    "data_exclusao_simples",
    "opcao_mei",
    "data_opcao_mei",
    "data_exclusao_mei",
)

CODE_LIST = ("codigo", "descricao")

# table name -> columns
REGISTRY_LAYOUTS = {
    "empresas": EMPRESAS,
    "estabelecimentos": ESTABELECIMENTOS,
    "socios": SOCIOS,
    "simples": SIMPLES,
    "cnaes": CODE_LIST,
    "motivos": CODE_LIST,
    "municipios": CODE_LIST,
    "naturezas": CODE_LIST,
    "paises": CODE_LIST,
    "qualificacoes": CODE_LIST,
}

# table name -> ending of the published file name
REGISTRY_SUFFIXES = {
    "empresas": ".EMPRECSV",
    "estabelecimentos": ".ESTABELE",
    "socios": ".SOCIOCSV",
    "simples": ".SIMPLES.CSV",
    "cnaes": ".CNAECSV",
    "motivos": ".MOTICSV",
    "municipios": ".MUNICCSV",
    "naturezas": ".NATJUCSV",
    "paises": ".PAISCSV",
    "qualificacoes": ".QUALSCSV",
}

# table name -> folder of the landing zone; sliced tables add the slice number
REGISTRY_FOLDERS = {
    "empresas": "Empresas",
    "estabelecimentos": "Estabelecimentos",
    "socios": "Socios",
    "simples": "Simples",
    "cnaes": "Cnaes",
    "motivos": "Motivos",
    "municipios": "Municipios",
    "naturezas": "Naturezas",
    "paises": "Paises",
    "qualificacoes": "Qualificacoes",
}
SLICED_TABLES = ("empresas", "estabelecimentos", "socios")

# ---------------------------------------------------------------------------
# Debt and sanction files (header names vary between files)
# ---------------------------------------------------------------------------

FEDERAL_DEBT_CATEGORIES = (
    "Dívida Ativa - Geral",
    "Dívida Ativa - Previdenciária",
    "Dívida Ativa - FGTS",
)

FEDERAL_DEBT_ALIASES = {
    "cpf_cnpj": ("cpf_cnpj", "cnpj_cpf", "ni_devedor", "cpfcnpj"),
    "tipo_pessoa": ("tipo_pessoa", "tipo_de_pessoa"),
    "tipo_devedor": ("tipo_devedor", "tipo_de_devedor"),
    "nome_devedor": ("nome_devedor", "nome_do_devedor", "nome"),
    "uf_devedor": ("uf_devedor", "uf_unidade_responsavel", "uf"),
    "unidade_responsavel": ("unidade_responsavel", "unidade_de_responsavel"),
    "numero_inscricao": ("numero_inscricao", "numero_da_inscricao"),
    "situacao_inscricao": ("situacao_inscricao", "situacao_da_inscricao"),
    "receita_principal": ("receita_principal", "tipo_de_receita", "receita"),
    "data_inscricao": ("data_inscricao", "data_da_inscricao"),
    "indicador_ajuizado": ("indicador_ajuizado", "ajuizado"),
    "valor_consolidado": ("valor_consolidado", "valor", "valor_total"),
}

SANCTION_REGISTERS = ("CEIS", "CNEP", "CEPIM")

SANCTION_ALIASES = {
    "cpf_cnpj": (
        "cpf_ou_cnpj_do_sancionado",
        "cnpj_ou_cpf_do_sancionado",
        "cpf_cnpj_do_sancionado",
        "cnpj_cpf",
        "cpf_cnpj",
        "cnpj",
    ),
    "nome": (
        "nome_informado_pelo_orgao_sancionador",
        "razao_social_cadastro_receita",
        "nome_do_sancionado",
        "nome_da_entidade",
        "nome",
    ),
    "tipo_sancao": ("tipo_de_sancao", "categoria_da_sancao", "motivo_do_impedimento"),
    "data_inicio": ("data_inicio_sancao", "data_de_inicio_da_sancao", "data_inicio"),
    "data_fim": ("data_final_sancao", "data_de_fim_da_sancao", "data_fim"),
    "orgao_sancionador": (
        "orgao_sancionador",
        "nome_do_orgao_superior",
        "orgao_superior",
        "concedente",
    ),
    "uf": ("uf_do_sancionado", "uf", "uf_da_entidade"),
    "fundamentacao": ("fundamentacao_legal", "descricao_da_fundamentacao_legal"),
}

# The newest sanction file may be at most this many days old (today counts as one).
SNAPSHOT_DAYS = 10

# State debt: the seven cells of a workbook row, by position.
STATE_DEBT_CELLS = (
    "cpf_cnpj",
    "nome_devedor",
    "numero_cda",
    "data_serial",
    "especie",
    "saldo_cda",
    "saldo_nucleo",
)

# Day zero of spreadsheet serial dates.
SERIAL_DAY_ZERO = "1899-12-30"

CNPJ_LENGTH = 14
DATE_SENTINELS = ("0", "00000000")

# ---------------------------------------------------------------------------
# Code lists
# ---------------------------------------------------------------------------

HEAD_OFFICE = "1"
STATUS_ACTIVE = "02"
STATUS_SUSPENDED = "03"
STATUS_UNFIT = "04"
SIZE_OTHERS = "05"
SIZE_SMALL = ("01", "03")

SIZE_NAMES = {
    "00": "Não informado",
    "01": "Microempresa",
    "03": "Empresa de pequeno porte",
    "05": "Demais",
}

STATUS_NAMES = {
    "02": "Ativa",
    "03": "Suspensa",
    "04": "Inapta",
}

# First four digits of activities that must use the "Lucro Real" regime by law.
MANDATORY_LUCRO_REAL_ACTIVITIES = (
    "6410", "6421", "6422", "6423", "6424", "6431", "6432", "6433", "6435",
    "6436", "6437", "6438", "6440", "6450", "6461", "6462", "6463", "6470",
    "6491", "6492", "6493", "6499", "6511", "6512", "6520", "6530", "6541",
)

# ---------------------------------------------------------------------------
# Result texts
# ---------------------------------------------------------------------------

REGIME_MANDATORY = "Lucro Real (obrigatório por atividade)"
REGIME_REAL = "Lucro Real (provável)"
REGIME_PRESUMED = "Lucro Presumido (provável)"
REGIME_PRESUMED_SMALL = "Lucro Presumido (provável — ME/EPP fora do Simples)"
REGIME_UNKNOWN = "Indeterminado"
REGIME_REAL_PREFIX = "Lucro Real"
REGIME_PRESUMED_PREFIX = "Lucro Presumido"

CONFIDENCE_HIGH = "Alta"
CONFIDENCE_MEDIUM = "Média"
CONFIDENCE_LOW = "Baixa"
CONFIDENCE_NONE = "Nenhuma"

FORECAST_FEDERAL_DEBT_UNFIT = "NEGATIVA IMPROVÁVEL — dívida ativa + inapta"
FORECAST_FEDERAL_DEBT = "NEGATIVA IMPROVÁVEL — inscrição em dívida ativa da União"
FORECAST_STATE_DEBT_UNFIT = "NEGATIVA IMPROVÁVEL — dívida ativa estadual + inapta"
FORECAST_STATE_DEBT = "NEGATIVA IMPROVÁVEL — inscrição em dívida ativa estadual (MG)"
FORECAST_UNFIT = "RISCO ALTO — cadastro inapto"
FORECAST_SUSPENDED = "RISCO — cadastro suspenso"
FORECAST_CLEAR = "SEM APONTAMENTO NAS FONTES ABERTAS"

TEXT_FEDERAL_DEBT = "Dívida ativa da União ("
TEXT_STATE_DEBT = "Dívida ativa estadual MG ("
TEXT_ONE_INSCRIPTION = " inscrição, R$ "
TEXT_MANY_INSCRIPTIONS = " inscrições, R$ "
TEXT_SUED = "Débito ajuizado (execução fiscal)"
TEXT_UNFIT = "Cadastro INAPTO"
TEXT_SUSPENDED = "Cadastro SUSPENSO"
TEXT_SANCTION = "Sanção: "
TEXT_LEFT_SIMPLES = "Excluída do Simples em "
TEXT_UNKNOWN_DATE = "?"
TEXT_DASH = " — "
LIST_SEPARATOR = " | "
FINDING_SEPARATOR = " • "

# Tags of a lead: severity and text.
TAG_FEDERAL_DEBT = ("critical", "Dívida União · ")
TAG_SUED = ("critical", "Ajuizado")
TAG_STATE_DEBT = ("critical", "Dívida MG · ")
TAG_UNFIT = ("serious", "Inapta")
TAG_SUSPENDED = ("serious", "Suspensa")
TAG_SANCTION = ("warning", "Sanção · ")
TAG_LEFT_SIMPLES = ("neutro", "Saiu do Simples")
TAG_NONE = ("good", "Sem apontamento")

EMPTY_MARK = "—"
SHARE_SUFFIX = "% do universo"

# Lead sheet: column and title, in sheet order.
EXPORT_COLUMNS = (
    ("cnpj_formatado", "CNPJ"),
    ("razao_social", "Razão social"),
    ("nome_fantasia", "Nome fantasia"),
    ("municipio", "Município"),
    ("regime_provavel", "Regime provável"),
    ("regime_confianca", "Confiança"),
    ("porte", "Porte"),
    ("capital_social", "Capital social"),
    ("situacao", "Situação"),
    ("cnae_descricao", "Atividade principal"),
    ("score", "Score"),
    ("apontamentos_texto", "Apontamentos"),
    ("cnd_federal_prognostico", "Prognóstico CND federal"),
    ("dau_qtd_inscricoes", "Inscrições DAU"),
    ("dau_valor_total", "Valor DAU (R$)"),
    ("cdt_estadual_mg_prognostico", "Prognóstico CDT estadual (MG)"),
    ("dam_qtd_inscricoes", "Inscrições dívida MG"),
    ("dam_valor_total", "Valor dívida MG (R$)"),
    ("telefone", "Telefone"),
    ("email", "E-mail"),
)

# Overview: line titles.
OVERVIEW_UNIVERSE_RAW = "Fora do Simples/MEI em MG (universo bruto)"
OVERVIEW_BECOME_LEADS = "Com apontamento → viram lead"
OVERVIEW_DISCARDED = "Descartadas por não terem apontamento"
OVERVIEW_UNIVERSE_TOTAL = "Total no universo (fora do Simples/MEI)"
OVERVIEW_WITH_FINDING = "Com ao menos um apontamento"
OVERVIEW_REAL = "Lucro Real provável"
OVERVIEW_PRESUMED = "Lucro Presumido provável"
OVERVIEW_FEDERAL_DEBT = "Com dívida ativa da União"
OVERVIEW_FEDERAL_VALUE = "Valor total em dívida ativa (União)"
OVERVIEW_STATE_DEBT = "Com dívida ativa estadual (MG)"
OVERVIEW_STATE_VALUE = "Valor total em dívida ativa (MG)"
OVERVIEW_IRREGULAR = "Situação cadastral irregular"
OVERVIEW_SANCTIONED = "Com sanção (CEIS/CNEP/CEPIM)"
OVERVIEW_LEFT_SIMPLES = "Excluídas do Simples"
