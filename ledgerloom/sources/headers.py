"""Sheet headers of the domain files and the columns they become."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.readers import fold_header, sysdate_columns

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# Headers that differ in case, accents or spaces only are columns of their own.
# ---------------------------------------------------------------------------
MOVEMENT_HEADERS = {
    "ID_INGRESO": "id_ingreso",
    "Id_cliente": "id_cliente",
    "Factura": "factura",
    "Fecha": "fecha",
    "Descripción": "descripcion",
    "Descripcion": "descripcion_plain",
    "Descripcion Motivo": "descripcion_motivo",
    "Documento": "documento",
    "Transaccion": "transaccion",
    "Oficina de Recaudo": "oficina_recaudo",
    "ID Origen/Destino": "id_origen_destino",
    "REFERENCIA": "referencia",
    "Referencia 1": "referencia_1",
    "Referencia 2": "referencia_2",
    "Valor": "valor",
    "VALOR": "valor_upper",
    "Valor Total": "valor_total",
    "VALOR TOTAL": "valor_total_upper",
    "Monto": "monto",
    "MontoCop": "monto_cop_compact",
    "MontoCOP": "monto_cop_upper",
    "Monto COP": "monto_cop",
    "Nombre del producto": "producto",
}
CLIENT_HEADERS = {
    "Identificación (Obligatorio)": "identificacion",
    "Nombres del tercero (Obligatorio)": "nombres",
    "Apellidos del tercero (Obligatorio)": "apellidos",
    "Nombre completo": "nombre_completo",
    "Dirección": "direccion",
    "Código departamento/estado": "codigo_departamento",
    "Código ciudad": "codigo_ciudad",
    "Teléfono principal": "telefono",
    "Correo electrónico contacto principal": "correo",
    "Tipo identificación": "tipo_identificacion",
    "Tipo (Obligatorio)": "tipo",
    "Código pais": "codigo_pais",
    "Tipo de régimen IVA": "tipo_regimen_iva",
    "Código Responsabilidad fiscal": "codigo_responsabilidad_fiscal",
    "Identificación del vendedor": "identificacion_vendedor",
    "Clientes": "clientes",
    "Estado": "estado",
    "Nombres contacto principal": "nombres_contacto",
    "Apellidos contacto principal": "apellidos_contacto",
    "Teléfono contacto principal": "telefono_contacto",
}
# ---------------------------------------------------------------------------


def apply_headers(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Columns renamed by their header, taken by position.

    An unlisted header becomes its folded form with ``_`` for spaces. Columns
    that get one name are coalesced, listed headers first. System-date
    headers stay as they are (``normalise_sysdate`` ranks them) and come last.
    """
    plain = df.toDF(*[f"_{k}" for k in range(len(df.columns))])
    dates = sysdate_columns(df.columns)
    groups: dict[str, list[int]] = {}
    for k in sorted(range(len(df.columns)), key=lambda k: df.columns[k].strip() not in headers):
        header = df.columns[k]
        if header not in dates:
            name = headers.get(header.strip(), fold_header(header).strip().replace(" ", "_"))
            groups.setdefault(name, []).append(k)
    order = sorted(groups, key=lambda name: min(groups[name]))
    cols = []
    for name in order:
        own = [plain[f"_{k}"] for k in groups[name]]
        if len({plain.schema[f"_{k}"].dataType for k in groups[name]}) > 1:
            own = [c.cast("string") for c in own]
        cols.append((own[0] if len(own) == 1 else F.coalesce(*own)).alias(name))
    return plain.select(*cols, *[plain[f"_{df.columns.index(c)}"].alias(c) for c in dates])
