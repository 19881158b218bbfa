"""Independent SQL for the registered queries, run by DuckDB on the same tables."""

from checks import views as v
from retailoom import fixed, seed_values

D = "date '2001-08-01'"


def u(x):
    """Ten-thousandths of a double."""
    return f"cast(floor(({x}) * 10000e0 + 0.5e0) as bigint)"


def es(x, extra=""):
    """Exact sum."""
    return f"(cast(sum({u(x)}){extra} as double) / 10000e0)"


def hu(x, d):
    """Round half away from zero."""
    return f"(sign({x}) * floor(abs({x}) * 1e{d} + 0.5e0) / 1e{d} + 0e0)"


def rat(a, b):
    return f"(cast({a} as double) / nullif(cast({b} as double), 0e0))"


def pct(a, b):
    return hu(f"({rat(a, b)} * 100e0)", 1)


def back(months):
    return f"({D} - interval {months} month)::date"


def in_list(values):
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + ")"


FR = in_list(fixed.FRANCE_GROUP)
ALL = "('SED', 'HIP')"


def norm(x, year=False):
    """Normalised name."""
    out = f"regexp_replace(upper({x}), '[.,/_-]', '', 'g')"
    out = f"regexp_replace({out}, '\\s+({'|'.join(fixed.LEGAL_FORMS)})\\s*$', '')"
    if year:
        out = f"regexp_replace({out}, '\\s*[0-9]{{4}}\\s*$', '')"
    return f"regexp_replace({out}, '\\s+', '', 'g')"


def dept_customer(z):
    return f"case when {z} like '97%' then left({z}, 3) when length({z}) >= 4 then left({z}, 2) end"


def dept_geo(z):
    return (f"case when {z} like '97%' and length(trim({z})) >= 3 then left(trim({z}), 3)"
            f" when try_cast(left(trim({z}), 2) as bigint) is not null then left(trim({z}), 2) end")


def dept_register(z):
    return (f"case when {z} like '97%' then left({z}, 3)"
            f" when {z} like '20%' then case when try_cast(left({z}, 5) as int) between 20200 and 20620 then '2B' else '2A' end"
            f" when length({z}) >= 4 then left({z}, 2) end")


def up(c):
    """Upper case with the full mapping of the sharp s, which DuckDB's upper leaves out."""
    return f"upper(replace({c}, 'ß', 'ss'))"


def garment(c):
    whens = " ".join(f"when regexp_matches({up(c)}, '{p}') then '{t}'" for t, p in fixed.GARMENT_RULES)
    return f"case {whens} else '{fixed.GARMENT_DEFAULT}' end"


def tags(c):
    parts = ", ".join(
        f"case when regexp_matches({up(f"coalesce({c}, '')")}, '\\b({p})\\b') then '{t}' end" for t, p in fixed.SHOP_TAG_RULES
    )
    return f"list_filter([{parts}], lambda x: x is not null)"


def season(d):
    return (f"case when month({d}) between 3 and 8 then 'SS_' || year({d})"
            f" when month({d}) >= 9 then 'AH_' || year({d}) else 'AH_' || (year({d}) - 1) end")


def season_sort(x):
    return f"cast(substr({x}, 4) as int)"


CHAINS = "\\b(" + "|".join(seed_values.chain_rows()) + ")\\b"
CHAINS_SQL = CHAINS.replace("'", "''")
SHOPS_VALUES = "(values ('HIP'), ('SED'), ('HPC'), ('ACC')) as shops(boutique_id)"
SEED_VALUES = ", ".join(
    "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in seed_values.department_rows()
)
COUNTRY_VALUES = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in fixed.COUNTRIES)
HEADCOUNT_CASE = " ".join(f"when '{k}' then '{t}'" for k, t in fixed.HEADCOUNT_LABELS.items())


def traffic(known):
    return (f"case when not ({known}) then 'gris' when coalesce(churn_alert, false) and recency_days >= 120 then 'rouge'"
            " when coalesce(churn_alert, false) or coalesce(reorder_status = 'en_retard', false) then 'orange' else 'vert' end")


def segment(known, vip):
    return (f"case when not ({known}) then 'inactif' when first_invoice_date >= {D} - 90 then 'nouveau'"
            " when recency_days > 365 then 'inactif' when recency_days > 180 then 'endormi'"
            f" when ({vip}) and frequency_12m >= 3 and recency_days <= 90 then 'vip'"
            " when frequency_12m >= 2 and recency_days <= 90 then 'actif' else 'saisonnier' end")


ID_COLS = ("customer_key, customer_id, customer_name, civility, address1, address2, zip_code, city, dept_code,"
           " country_iso_code, is_france, email, phone, siren, vat_number, naf_code, longitude, latitude")
PROFILE = ("customer_key, boutique_id, customer_id, customer_name, civility, address1, address2, zip_code, city, dept_code,"
           " country_iso_code, is_france, email, phone, siren, vat_number, naf_code, longitude, latitude,"
           " first_invoice_date, last_invoice_date, nb_orders_total, ca_total_ht, ca_12m_ht, ca_6m_ht, ca_trend_6m_pct,"
           " avg_basket_ht, last_order_date, recency_days, churn_alert, reorder_status, rfm_global_score, frequency_12m,"
           " rfm_recency_score, rfm_frequency_score, rfm_monetary_score, churn_color, segment, unified_key, presence")

# name -> (needed CTEs, SQL)
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name, needs, sql):
    CTES[name] = (needs, sql)


cte("docs", [], f"select {v.select_list(v.DOCS)} from orders")
cte("lines", [], f"select {v.select_list(v.LINES)} from lineitem join orders on l_orderkey = o_orderkey")
cte("moves", [], f"select {v.select_list(v.MOVES)} from lineitem join orders on l_orderkey = o_orderkey")
cte("cust0", [], f"""select * exclude (country_raw), {dept_customer('zip_code')} as dept_code,
  case when country_raw = '' then 'FR' else country_raw end as country_iso_code
  from (select {v.select_list(v.CUST)} from customer)""")
cte("cust", ["cust0"], f"""select * exclude (raw_key, nm, lo, hi),
    case when raw_key is not null and lo = hi then raw_key else 'FALLBACK:' || boutique_id || '|' || id end as unified_key
  from (select *, min(nm) over (partition by raw_key) as lo, max(nm) over (partition by raw_key) as hi
    from (select *,
      case when regexp_full_match(regexp_replace(coalesce(siren, ''), '\\s+', '', 'g'), '[0-9]{{9}}')
             then 'SIREN:' || regexp_replace(siren, '\\s+', '', 'g')
           when length(regexp_replace(coalesce(vat_number, ''), '\\s+', '', 'g')) >= 8
             then 'VAT:' || upper(regexp_replace(vat_number, '\\s+', '', 'g')) end as raw_key,
      {norm("coalesce(name, '')", True)} as nm from cust0))""")
cte("items", [], f"""select boutique_id, p.*, {garment('caption')} as type_vetement
  from (select {v.select_list(v.ITEMS)} from part) p cross join {SHOPS_VALUES}""")
cte("stock", [], f"""select boutique_id, s.* from (select {v.select_list(v.STOCK)}
  from (select *, unnest([{', '.join(v._STORES_OF_ITEM)}]) as store from part)) s cross join {SHOPS_VALUES}""")
cte("stores", [], f"select boutique_id, s.* from (select {v.select_list(v.STORES)} from nation) s cross join {SHOPS_VALUES}")
cte("etab", [], f"select {v.select_list(v.ETAB)} from customer")
cte("units", [], f"select {v.select_list(v.LEGAL_UNITS)} from customer group by 1")
cte("status", [], f"select {v.select_list(v.STATUS)} from customer")
cte("seed", [], f"select * from (values {SEED_VALUES}) as t(dept_code, dept_name, region_name)")
cte("kept", ["etab"], f"""select {', '.join(f"coalesce({c}, '') as {c}" for c in fixed.ESTABLISHMENT_COLUMNS)} from etab
  where activitePrincipaleEtablissement = '47.71Z' and etatAdministratifEtablissement = 'A'
    and trim(codePaysEtrangerEtablissement) = ''""")
cte("keptu", ["kept", "units"], f"""select {', '.join(f"coalesce({c}, '') as {c}" for c in fixed.LEGAL_UNIT_COLUMNS)} from units
  where etatAdministratifUniteLegale = 'A' and siren in (select siren from kept)""")
cte("reg", ["kept", "keptu"], f"""select siret, e.siren, nic,
   coalesce(nullif(trim(enseigne1Etablissement), ''), usual, legal, nullif(trim(nom || ' ' || pre), '')) as denomination,
   cat as categorie_juridique,
   case when cat like '1%' then 'ei' when cat like '5%' then 'societe' else 'autre' end as forme_juridique,
   trim(numeroVoieEtablissement || ' ' || typeVoieEtablissement || ' ' || libelleVoieEtablissement) as adresse_voie,
   complementAdresseEtablissement as adresse_complement, codePostalEtablissement as zip_code,
   libelleCommuneEtablissement as city, codeCommuneEtablissement as insee_code,
   {dept_register('codePostalEtablissement')} as dept_code,
   try_cast(nullif(dateCreationEtablissement, '') as date) as date_creation,
   trancheEffectifsEtablissement as tranche_effectif_code,
   case trancheEffectifsEtablissement {HEADCOUNT_CASE} end as tranche_effectif_libelle,
   activitePrincipaleEtablissement as naf_code, etatAdministratifEtablissement as etat_admin,
   {norm('coalesce(usual, legal)')} as denomination_normalized
  from (select *, nullif(trim(denominationUsuelleEtablissement), '') as usual from kept) e
  left join (select siren as us, nullif(trim(denominationUniteLegale), '') as legal,
      nullif(trim(categorieJuridiqueUniteLegale), '') as cat, nomUniteLegale as nom, prenomUsuelUniteLegale as pre
      from keptu) on us = e.siren""")

cte("days", ["docs"], f"""select distinct customer_key, boutique_id, customer_id, document_date from docs
  where is_valid_sale and document_date >= {back(24)}""")
cte("gaps", ["days"], """select customer_key, document_date,
  cast(document_date - lag(document_date) over (partition by customer_key order by document_date) as bigint) as interval_days from days""")
cte("median", ["gaps"], """select customer_key, quantile_cont(interval_days, 0.5) as median_frequency_days
  from gaps where interval_days > 0 group by customer_key""")
cte("base", ["days", "median", "docs", "cust0"], f"""select o.*, name as customer_name, median_frequency_days,
    (last_order_date + cast(floor(median_frequency_days + 0.5) as integer))::date as next_expected_date,
    cast({D} - last_order_date as bigint) as recency_days,
    coalesce(f, 0) as frequency_12m, coalesce(m, 0e0) as monetary_12m
  from (select customer_key, boutique_id, customer_id, count(*) as order_count_24m, max(document_date) as last_order_date
        from days group by all) o
  left join median using (customer_key)
  left join (select customer_key, count(distinct id) as f, {es('amount_ht')} as m from docs
        where is_valid_sale and document_date >= {back(12)} group by 1) y using (customer_key)
  left join (select customer_key, name from cust0) using (customer_key)""")
cte("statused", ["base"], f"""select *, cast({D} - next_expected_date as bigint) as days_overdue,
    case when order_count_24m < 3 or next_expected_date is null then 'insuffisant'
         when {D} - next_expected_date > 7 then 'en_retard' when {D} - next_expected_date >= 0 then 'du_semaine'
         else 'a_venir' end as reorder_status from base""")
cte("rfm", ["statused"], """select *, a + b + c as rfm_global_score, recency_days > 60 and a + b + c < 8 as churn_alert
    from (select *, rfm_recency_score as a, rfm_frequency_score as b, rfm_monetary_score as c from (
      select *, ntile(5) over (order by recency_days desc, customer_key) as rfm_recency_score,
        ntile(5) over (order by frequency_12m, customer_key) as rfm_frequency_score,
        ntile(5) over (order by monetary_12m, customer_key) as rfm_monetary_score from statused))""")
cte("churn", ["rfm", "docs"], f"""select r.* exclude (order_count_24m, median_frequency_days, next_expected_date, days_overdue,
       reorder_status, churn_alert, a, b, c, g),
    concat_ws(',', case when recency_days > 60 then 'inactivite' end, case when b <= 2 then 'freq_basse' end,
       case when c <= 2 then 'ca_faible' end) as churn_signals,
    case when recency_days > 180 or rfm_global_score <= 5 then 'critique' when recency_days > 90 and rfm_global_score <= 8 then 'modere'
         when recency_days > 60 and rfm_global_score < 10 then 'surveillance' end as churn_level,
    case when g > 0.15e0 then 'hausse' when g < -0.15e0 then 'baisse' when g is not null then 'stable' end as ca_trend,
    {hu('(g * 100e0)', 1)} as ca_trend_pct
  from (select *, {rat('monetary_12m - monetary_prev_12m', 'monetary_prev_12m')} as g from rfm
     left join (select customer_key, {es('amount_ht')} as monetary_prev_12m from docs
       where is_valid_sale and document_date >= {back(24)} and document_date < {back(12)} group by 1) p using (customer_key)) r
  where order_count_24m >= 3 and churn_level is not null""")

cte("sums", ["docs"], f"""select customer_key, boutique_id, count(distinct id) as nb_orders_total, {es('amount_ht')} as ca_total_ht,
    {es(f"case when document_date >= {back(6)} then amount_ht end")} as ca_6m_ht,
    {es(f"case when document_date >= {back(12)} and document_date < {back(6)} then amount_ht end")} as ca_6m_n1_ht
  from docs where is_valid_sale group by 1, 2""")
cte("vip", ["sums"], "select boutique_id, quantile_cont(ca_total_ht, 0.9) as ca_p90 from sums group by 1")
cte("prof0", ["cust", "sums", "vip", "rfm"], f"""select c.customer_key, c.boutique_id, id as customer_id, name as customer_name, civility,
    address1, address2, zip_code, city, dept_code, country_iso_code, country_iso_code is null or country_iso_code in {FR} as is_france,
    email, phone, siren, vat_number, naf_code, longitude, latitude, first_invoice_date, last_invoice_date,
    coalesce(nb_orders_total, 0) as nb_orders_total, coalesce(s.ca_total_ht, 0e0) as ca_total_ht, coalesce(monetary_12m, 0e0) as ca_12m_ht,
    coalesce(ca_6m_ht, 0e0) as ca_6m_ht, coalesce(ca_6m_n1_ht, 0e0) as ca_6m_n1_ht,
    coalesce(r.last_order_date, last_invoice_date) as last_order_date,
    coalesce(r.recency_days, cast({D} - last_invoice_date as bigint)) as recency_days,
    churn_alert, reorder_status, rfm_global_score, frequency_12m, rfm_recency_score, rfm_frequency_score, rfm_monetary_score,
    r.customer_key is not null as known, coalesce(s.ca_total_ht >= ca_p90, false) as is_vip, unified_key
  from cust c left join sums s on s.customer_key = c.customer_key left join vip w on w.boutique_id = c.boutique_id
  left join rfm r on r.customer_key = c.customer_key""")


def derived(src, known, vip):
    trend = pct("ca_6m_ht - ca_6m_n1_ht", "ca_6m_n1_ht")
    basket = f"coalesce({hu(rat('ca_total_ht', 'nb_orders_total'), 2)}, 0e0)"
    return (f"select *, {trend} as ca_trend_6m_pct, {basket} as avg_basket_ht, {traffic(known)} as churn_color,"
            f" {segment(known, vip)} as segment from {src}")


cte("prof", ["prof0"], f"select {PROFILE} from (select *, cast(null as string) as presence from ({derived('prof0', 'known', 'is_vip')}))")
cte("hipp", ["prof0"], f"""select {PROFILE} from (select *, 'HIPP' as boutique_id from ({derived('''(
    select w.*, first_invoice_date, last_invoice_date, nb_orders_total, ca_total_ht, ca_12m_ht, ca_6m_ht, ca_6m_n1_ht, frequency_12m,
      last_order_date, recency_days, churn_alert, presence, unified_key,
      cast(null as string) as reorder_status, cast(null as bigint) as rfm_global_score, cast(null as bigint) as rfm_recency_score,
      cast(null as bigint) as rfm_frequency_score, cast(null as bigint) as rfm_monetary_score
    from (select unified_key as uk, ''' + ID_COLS + ''' from prof0 where boutique_id in ('SED', 'HIP') and unified_key not like 'FALLBACK:%'
          qualify row_number() over (partition by unified_key order by ca_total_ht desc, customer_key desc) = 1) w
    join (select unified_key, min(first_invoice_date) as first_invoice_date, max(last_invoice_date) as last_invoice_date,
        cast(sum(nb_orders_total) as bigint) as nb_orders_total, ''' + es('ca_total_ht') + ' as ca_total_ht, ' + es('ca_12m_ht') + ' as ca_12m_ht, '
        + es('ca_6m_ht') + ' as ca_6m_ht, ' + es('ca_6m_n1_ht') + ''' as ca_6m_n1_ht, cast(sum(coalesce(frequency_12m, 0)) as bigint) as frequency_12m,
        max(last_order_date) as last_order_date, min(recency_days) as recency_days, bool_or(churn_alert) as churn_alert,
        case when count(distinct boutique_id) = 2 then 'both' when any_value(boutique_id) = 'SED' then 'sed_only' else 'hip_only' end as presence
      from prof0 where boutique_id in ('SED', 'HIP') and unified_key not like 'FALLBACK:%' group by 1) m on w.uk = m.unified_key
    union all by name
    select ''' + ID_COLS + ''', first_invoice_date, last_invoice_date, nb_orders_total, ca_total_ht, ca_12m_ht, ca_6m_ht, ca_6m_n1_ht,
      coalesce(frequency_12m, 0) as frequency_12m, last_order_date, recency_days, churn_alert,
      case boutique_id when 'SED' then 'sed_only' else 'hip_only' end as presence, unified_key, unified_key as uk,
      cast(null as string) as reorder_status, cast(null as bigint) as rfm_global_score, cast(null as bigint) as rfm_recency_score,
      cast(null as bigint) as rfm_frequency_score, cast(null as bigint) as rfm_monetary_score
    from prof0 where boutique_id in ('SED', 'HIP') and unified_key like 'FALLBACK:%')''', 'ca_total_ht <> 0', 'true')}))""")
cte("detail", ["prof", "hipp"], "select * from prof union all by name select * from hipp")

cte("owed", ["docs", "cust0"], f"""select d.customer_key, d.boutique_id, d.customer_id, c.name as customer_name, c.city,
    count(distinct d.id) as nb_invoices_overdue, {es('balance_due')} as total_overdue_ht,
    min(document_date) as oldest_overdue_date, max(document_date) as latest_overdue_date
  from docs d join cust0 c on c.customer_key = d.customer_key
  where document_type = 2 and is_valid_sale and balance_due > 0 group by all""")
cte("grp", ["cust0"], "select customer_key from cust0 where siren is not null")

cte("fcust", ["cust0"], f"""select customer_key, boutique_id, {dept_geo('zip_code')} as gdept from cust0
  where zip_code is not null and (country_iso_code is null or country_iso_code in {FR})""")
cte("bydept", ["fcust", "docs", "seed"], f"""select t.dept_code, coalesce(dept_name, t.dept_code) as dept_name, boutique_id,
    revenue_ht_12m, active_customers_12m, order_count_12m, {hu(rat('revenue_ht_12m', 'order_count_12m'), 2)} as avg_basket_ht,
    (t.dept_code between '01' and '95') or t.dept_code in ('2A', '2B') as is_metro
  from (select gdept as dept_code, d.boutique_id, {es('amount_ht')} as revenue_ht_12m, count(distinct d.customer_key) as active_customers_12m,
        count(distinct d.id) as order_count_12m
      from docs d join fcust f on f.customer_key = d.customer_key
      where is_valid_sale and document_date >= {back(12)} and gdept is not null group by 1, 2) t
  left join seed on seed.dept_code = t.dept_code""")
cte("bycountry", ["cust0", "docs"], f"""select country_iso_code, c.boutique_id, count(distinct c.customer_key) as nb_customers_total,
    count(distinct d.customer_key) as nb_customers_actifs_12m, coalesce({es('amount_ht')}, 0e0) as ca_12m_ht,
    count(distinct d.id) as nb_orders_12m, country_iso_code in {FR} as is_france_group
  from cust0 c left join docs d on d.customer_key = c.customer_key and is_valid_sale and document_date >= {back(12)}
  where country_iso_code <> '' group by 1, 2""")


def geo_france(shops, cond):
    return f"""select t.dept_code, coalesce(dept_name, t.dept_code) as dept_name, revenue_ht, active_customers, order_count,
      {hu(rat('revenue_ht', 'order_count'), 2)} as avg_basket_ht
    from (select gdept as dept_code, {es('amount_ht')} as revenue_ht, count(distinct d.customer_key) as active_customers,
        count(distinct d.boutique_id || d.id) as order_count
      from docs d join fcust f on f.customer_key = d.customer_key
      where is_valid_sale and d.boutique_id in {shops} and ({cond}) and gdept is not null group by 1) t
    left join seed on seed.dept_code = t.dept_code
    where (t.dept_code >= '01' and t.dept_code <= '95') or t.dept_code in ('2A', '2B')"""


def geo_countries(shops, cond):
    return f"""select country_iso_code, count(distinct c.customer_key) as nb_customers_total,
      count(distinct d.customer_key) as nb_customers_actifs, {es('amount_ht')} as ca_ht, count(distinct d.boutique_id || d.id) as nb_orders
    from cust0 c left join docs d on d.customer_key = c.customer_key and is_valid_sale and ({cond})
    where country_iso_code not in {FR} and c.boutique_id in {shops} group by 1 having {es('amount_ht')} > 0"""


def place_customers(place, shops, key, cond):
    return f"""select {key} as group_key, arg_min(c.id, c.customer_key) as customer_id, arg_min(c.name, c.customer_key) as customer_name,
      first(c.city order by c.customer_key) as city, {es('s')} as ca_total_ht, max(last) as last_order_date, cast(sum(n) as bigint) as nb_orders
    from cust c join (select customer_key, {es('amount_ht')} as s, max(document_date) as last, count(distinct id) as n from docs
      where is_valid_sale and boutique_id in {shops} and ({cond}) group by 1) using (customer_key)
    where s > 0 and c.boutique_id in {shops} and {place} group by 1 order by ca_total_ht desc, group_key"""


cte("perf0", ["lines", "docs"], f"""select d.boutique_id, item_id, {season('document_date')} as season_label,
    {es('quantity')} as qty_sold_season, {es('net_amount_ht')} as revenue_ht_season, {es('margin_ht')} as margin_ht_season
  from lines l join docs d on d.id = l.document_id and d.boutique_id = l.boutique_id
  where is_valid_sale and quantity > 0 group by 1, 2, 3""")
cte("perf", ["perf0", "items"], f"""select s.boutique_id, s.item_id, s.season_label, caption as item_caption, type_vetement,
    s.qty_sold_season, s.revenue_ht_season, s.margin_ht_season, {pct('s.margin_ht_season', 's.revenue_ht_season')} as margin_rate,
    real_stock as real_stock_current, s.season_label = 'SS_2001' as is_current_season, p.revenue_ht_season as revenue_ht_season_n1,
    {pct('s.revenue_ht_season - p.revenue_ht_season', 'p.revenue_ht_season')} as ca_trend_season_pct
  from perf0 s join items i on i.boutique_id = s.boutique_id and i.id = s.item_id
  left join perf0 p on p.boutique_id = s.boutique_id and p.item_id = s.item_id
    and p.season_label = left(s.season_label, 3) || ({season_sort('s.season_label')} - 1)""")
cte("catalog", ["perf", "lines", "docs", "stock"], f"""select *, case when qty_sold_season + current_stock > 0
      then {pct('qty_sold_season', 'qty_sold_season + current_stock')} end as sell_through_pct
  from (select p.boutique_id, p.item_id, item_caption, type_vetement, qty_sold_season, revenue_ht_season as ca_season_ht, margin_ht_season,
    margin_rate, ca_trend_season_pct, revenue_ht_season_n1 as ca_prev_season_ht, coalesce(n, 0) as nb_clients_season,
    coalesce(q, real_stock_current, 0e0) as current_stock, season_label
   from perf p
   left join (select l.item_id, d.boutique_id, count(distinct customer_key) as n from lines l join docs d
      on d.id = l.document_id and d.boutique_id = l.boutique_id
      where is_valid_sale and document_date between date '2001-03-01' and date '2001-08-31' group by 1, 2) b
     on b.item_id = p.item_id and b.boutique_id = p.boutique_id
   left join (select item_id, boutique_id, {es('real_stock')} as q from stock group by 1, 2) k
     on k.item_id = p.item_id and k.boutique_id = p.boutique_id
   where season_label = 'SS_2001' and revenue_ht_season > 0)""")
cte("besties", ["lines", "docs", "cust0"], f"""select * from (select item_id, d.boutique_id, d.customer_key, customer_id, name as customer_name,
      {es('quantity')} as total_qty, {es('net_amount_ht')} as total_ca_ht, count(distinct d.id) as nb_orders, max(document_date) as last_order_date,
      row_number() over (partition by item_id, d.boutique_id order by {es('net_amount_ht')} desc, d.customer_key) as rank
    from lines l join docs d on d.id = l.document_id and d.boutique_id = l.boutique_id join cust0 c on c.customer_key = d.customer_key
    where is_valid_sale group by 1, 2, 3, 4, 5) where rank <= 10""")
cte("top5", ["lines", "docs", "items"], f"""select t.customer_key, t.boutique_id, rank, t.item_id, caption as item_caption, total_qty_12m, order_count_item,
    {rat('total_qty_12m', 'order_count_item')} as avg_qty_per_order
  from (select customer_key, d.boutique_id, item_id, {es('quantity')} as total_qty_12m, count(distinct document_id) as order_count_item,
      row_number() over (partition by customer_key order by {es('quantity')} desc, item_id) as rank
    from lines l join docs d on d.id = l.document_id and d.boutique_id = l.boutique_id
    where is_valid_sale and document_date >= {back(12)} and quantity > 0 group by 1, 2, 3) t
  left join items i on i.boutique_id = t.boutique_id and i.id = t.item_id where rank <= 5""")
cte("lastsale", ["perf"], "select * from perf where season_label = 'AH_2000'")

cte("stat", ["stock", "items", "stores", "lines", "docs", "moves"], f"""select *,
    case when real_stock = 0 then 0e0 when sales_30d = 0 then null else {hu(rat('real_stock', '(sales_30d / 3e1)'), 0)} end as coverage_days,
    real_stock <= 0 and virtual_stock <= 0 as is_rupture,
    real_stock > max_stock and max_stock > 0 and not (real_stock <= 0 and virtual_stock <= 0) as is_surstock,
    real_stock > 0 and not (real_stock <= 0 and virtual_stock <= 0)
      and (last_movement_date is null or last_movement_date < {D} - 90) as is_dormant,
    cast(case when real_stock <= 0 and virtual_stock <= 0 then 0 when real_stock > max_stock and max_stock > 0 then 1
      when real_stock > 0 and (last_movement_date is null or last_movement_date < {D} - 90) then 2 else 3 end as bigint) as urgency_rank
  from (select k.boutique_id, k.item_id, i.caption as item_caption, k.storehouse_id, h.caption as storehouse_name, k.real_stock, k.stock_value,
      min_stock, max_stock, virtual_stock, coalesce(sold, 0e0) as sales_30d, last_movement_date
    from stock k left join items i on i.boutique_id = k.boutique_id and i.id = k.item_id
    left join stores h on h.boutique_id = k.boutique_id and h.id = k.storehouse_id
    left join (select l.boutique_id, item_id, storehouse_id, {es('quantity')} as sold from lines l join docs d
        on d.id = l.document_id and d.boutique_id = l.boutique_id
        where is_valid_sale and document_date >= {D} - 30 and quantity > 0 group by 1, 2, 3) s
      on s.boutique_id = k.boutique_id and s.item_id = k.item_id and s.storehouse_id = k.storehouse_id
    left join (select boutique_id, item_id, max(document_date) as last_movement_date from moves group by 1, 2) m
      on m.boutique_id = k.boutique_id and m.item_id = k.item_id)""")

cte("clients", ["detail"], f"""select customer_key, siren, zip_code, {norm("coalesce(customer_name, '')")} as nm from detail
  where boutique_id = 'HIPP' and is_france""")
cte("matched", ["reg", "clients"], """select siret, coalesce(m2, m3) as matched_unified_key,
    case when m2 is not null then 'M2_SIREN' when m3 is not null then 'M3_NOM_CP' end as match_rule,
    m2 is null and m3 is null as is_prospect
  from (select siret, (select min(customer_key) from clients c where c.siren = r.siren) as m2,
      (select min(customer_key) from clients c where c.nm <> '' and c.nm = r.denomination_normalized and c.zip_code = r.zip_code) as m3
    from reg r)""")
cte("scored", ["reg"], f"""select *, cast((case when tranche_effectif_code not in ('NN', '00') then 30 else 0 end)
    + (case when date_creation < {back(24)} then 20 else 0 end) + (case when forme_juridique = 'societe' then 30 else 0 end)
    + (case when trim(denomination) not in ('', '[ND]') then 20 else 0 end) as bigint) as score_prospect from reg""")
cte("mart", ["scored", "matched"], f"""select s.* exclude (denomination_normalized), matched_unified_key, match_rule, is_prospect,
    {tags('denomination')} as tag_list,
    regexp_matches(upper(coalesce(denomination, '')), '{CHAINS_SQL}') as is_chain
  from scored s join matched using (siret)""")
MART_OUT = "* exclude (tag_list), array_to_string(tag_list, ',') as shop_type_tags"
cte("pbd", ["mart", "seed"], f"""select m.dept_code as code_departement, coalesce(any_value(dept_name), m.dept_code) as nom_departement,
    count(*) as nb_sirene_total, count(*) filter (not is_prospect) as nb_clients, count(*) filter (is_prospect) as nb_prospects_nets,
    count(*) filter (match_rule = 'M3_NOM_CP') as nb_matches_incertains,
    {pct('count(*) filter (not is_prospect)', 'count(*)')} as taux_penetration_pct
  from mart m left join seed on seed.dept_code = m.dept_code where m.dept_code is not null group by m.dept_code""")
cte("found", ["mart", "status"], """select siret, siren, denomination, adresse_voie, adresse_complement, zip_code, city, dept_code, date_creation,
    tranche_effectif_code, tranche_effectif_libelle, etat_admin, categorie_juridique, forme_juridique, score_prospect, is_chain, tag_list,
    coalesce(statut, 'a_contacter') as statut, note, dernier_contact, updated_at
  from mart left join status using (siret)
  where is_prospect and not is_chain and trim(denomination) not in ('', '[ND]')""")
cte("edits", [], """select case when c_custkey % 19 = 0 then '123' else lpad(cast(c_custkey as string), 14, '0') end as siret, statut,
    case when c_custkey % 23 = 0 then repeat('x', 501) when c_custkey % 2 = 0 then 'note ' || h end as note, dernier_contact,
    cast('2001-07-30 ' || h || ':00:00' as timestamp) as updated_at
  from (select c_custkey, 'contacte' as statut, '09' as h, cast(null as date) as dernier_contact from customer
    union all select c_custkey, case when c_custkey % 3 = 0 then 'a_contacter' when c_custkey % 17 = 0 then 'perdu' else 'pas_interesse' end, '11',
      case when c_custkey % 5 = 0 then date '2001-08-05' when c_custkey % 5 = 1 then date '2001-06-01' end from customer)""")
cte("judged", ["edits", "mart"], f"""select *, case when not regexp_full_match(siret, '[0-9]{{14}}') then 'siret'
    when statut not in ('a_contacter', 'contacte', 'pas_interesse') then 'statut' when length(note) > 500 then 'note'
    when dernier_contact > {D} then 'dernier_contact'
    when siret not in (select siret from mart where is_prospect) then 'unknown siret' end as reason from edits""")

# query -> (needed CTEs, SQL)
Q: dict[str, tuple[list[str], str]] = {}


def q(name, needs, sql):
    Q[name] = (needs, sql)


q("union_shops", ["cust0"], 'select boutique_id, id as "Id", name as "Name", zip_code as "MainInvoicingAddress_ZipCode" from cust0')
q("staged_customers", ["cust"], "select * from cust")
q("staged_items", ["items"], """select *, cast(null as string) as family_id, cast(null as string) as sub_family_id,
  cast(null as string) as supplier_id from items""")
q("staged_documents", ["docs"], """select *, case boutique_id when 'HIP' then 'PARIS MARAIS' when 'SED' then 'LYON PRESQUILE'
  when 'HPC' then 'MARSEILLE PRADO' else 'NANTES COMMERCE' end as boutique_name, cast(null as double) as discount_rate,
  case document_type when 2 then 'Facture' when 3 then 'Avoir' end as document_type_label from docs""")
q("staged_lines", ["lines"], """select *, document_id || '-' || item_id as id, cast(null as string) as description,
  cast(null as double) as price_ht from lines""")
q("staged_stock", ["stock"], "select *, 3e0 as ordered_quantity, cast(null as double) as suppliers_ordered_quantity from stock")
q("staged_movements", ["moves"], """select *, 'M' as document_number, 1.5e0 as unit_cost, -2e0 as cost, 0.5e0 as real_stock,
  case document_sub_type when '2' then 'achat' when '4' then 'vente' when '5' then 'sortie_autre' else 'transfert' end as mouvement_type from moves""")
q("staged_storehouses", ["stores"], """select *, case id when '0' then true when '1' then null else false end as is_main, '75001' as zip_code,
  'PARIS' as city, 2.35e0 as longitude, cast(null as double) as latitude from stores""")
q("safe_cast", [], """select event_id as row_id, cast(json_extract(props, '$.k') as bigint) as as_long,
  cast(json_extract(props, '$.k') as double) + 0.5e0 as as_double, cast(null as double) as comma_double, cast(ts as date) as as_date,
  cast(null as date) as month_only, cast(null as bigint) as text_long from events""")
q("dept_code", ["cust0"], f"""select customer_key, zip_code, {dept_customer('zip_code')} as dept_customer, {dept_geo('zip_code')} as dept_geo,
  {dept_register('zip_code')} as dept_register from cust0""")
q("normalize_name", ["cust0", "etab"], f"""select customer_key, {norm('name')} as normalized, {norm("name || ' 2021'", True)} as without_year
  from (select customer_key, name from cust0 union all select siret, denominationUsuelleEtablissement from etab)""")
q("entity_resolution", ["cust"], "select customer_key, siren, vat_number, unified_key from cust")
q("classify_keywords", ["items"], f"""select boutique_id, id, type_vetement,
  list_filter([{', '.join("'" + w + "'" for w in fixed.GARMENT_WORDS)}], lambda w: contains(upper(caption), w))[1] as type_word from items""")
q("classify_documents", [], f"select doc_id, {garment('text')} as garment, array_to_string({tags('text')}, ',') as tags from documents")
q("document_types", [], f"""select {v.shop('o_custkey')} as boutique_id, cast(case o_orderstatus when 'P' then 3 else 2 end as bigint) as document_type,
  case o_orderstatus when 'P' then 'Avoir' else 'Facture' end as label, o_orderstatus <> 'P' as is_valid_sale, count(*) as n
  from orders group by 1, 2, 3, 4""")
q("line_margin", ["lines"], f"""select boutique_id, item_id, {es('net_amount_ht - purchase_price * quantity')} as margin_ht from lines group by 1, 2""")
q("movement_types", [], f"""select {v.shop('o_custkey')} as boutique_id, case l_linenumber when 1 then 'achat' when 2 then 'sortie_autre'
  when 3 then 'transfert' else 'vente' end as mouvement_type, count(*) as n, cast(max(l_shipdate) as date) as last_day
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""")
q("filter_establishments", ["kept"], "select * from kept")
q("filter_legal_units", ["keptu"], "select * from keptu")
q("prospect_staging", ["reg"], "select * from reg")

q("order_days", ["days"], "select * from days")
q("order_intervals", ["gaps"], "select * from gaps")
q("median_interval", ["median"], "select * from median")
q("median_interval_approx", ["gaps"], """select customer_key, cast(quantile_disc(interval_days, 0.5) as double) as median_frequency_days
  from gaps where interval_days > 0 group by 1""")
DELAY = """case when days_overdue is null then 'Historique insuffisant' when reorder_status = 'en_retard' then format('En retard de {} j', days_overdue)
  when reorder_status = 'du_semaine' and days_overdue = 0 then 'À relancer aujourd''hui'
  when reorder_status = 'du_semaine' then format('En retard de {} j', days_overdue)
  when reorder_status = 'a_venir' then format('Dans {} jours', -days_overdue) else 'Historique insuffisant' end as delay"""
q("reorder_status", ["statused"], f"""select customer_key, customer_name, order_count_24m, next_expected_date, days_overdue, reorder_status, {DELAY}
  from statused""")
q("rfm", ["rfm"], "select * exclude (a, b, c) from rfm")
q("global_ntile", ["docs"], "select customer_key, id, amount_ht, ntile(7) over (order by amount_ht, id) as tile from docs where is_valid_sale")
q("churn_alerts", ["churn"], "select * from churn")
q("churn_list", ["churn", "cust0", "sums"], f"""select c.customer_key, c.boutique_id, customer_name, last_order_date, recency_days, monetary_12m, ca_trend,
  ca_trend_pct, churn_level, churn_signals, case when k.customer_key is not null then coalesce(ca_total_ht, 0e0) end as ca_total_ht
  from churn c left join cust0 k on k.customer_key = c.customer_key left join sums s on s.customer_key = c.customer_key
  where c.boutique_id in {ALL}""")
q("churn_filter", ["churn"], """select *, split_part(customer_key, '|', 2) as customer_id_from_key from churn
  where churn_level in ('critique', 'modere') and lower(customer_name) like '%00%' and recency_days >= 100""")
q("churn_level_counts", ["churn"], """select count(*) filter (churn_level = 'critique') as critique, count(*) filter (churn_level = 'modere') as modere,
  count(*) filter (churn_level = 'surveillance') as surveillance from churn""")
q("rfm_with_items", ["rfm", "top5"], f"""select customer_key, customer_id, customer_name, last_order_date, median_frequency_days, days_overdue,
  reorder_status, order_count_24m, coalesce(top5, '') as top5 from rfm left join (select customer_key,
    string_agg(rank || ':' || item_id || ':' || item_caption, ',' order by rank) as top5 from top5 where boutique_id in {ALL} group by 1)
  using (customer_key) where boutique_id in {ALL}""")
q("reorder_worklist", ["rfm", "top5"], f"""select customer_key, customer_name, reorder_status, days_overdue, {DELAY} from rfm
  where customer_key in (select customer_key from top5) and reorder_status <> 'insuffisant'""")
q("reorder_counts", ["rfm", "top5"], """select count(*) filter (reorder_status = 'en_retard') as en_retard, count(*) filter (reorder_status = 'du_semaine')
  as du_semaine, count(*) filter (reorder_status = 'a_venir') as a_venir from rfm where customer_key in (select customer_key from top5)""")

# the interpolated value differs between engines in the last bit, so it is stated in money units
q("vip_threshold", ["vip"], f"select boutique_id, {hu('ca_p90', 4)} as ca_p90 from vip")
q("revenue_trend_6m", ["sums"], f"""select *, {pct('ca_6m_ht - ca_6m_n1_ht', 'ca_6m_n1_ht')} as ca_trend_6m_pct,
  coalesce({hu(rat('ca_total_ht', 'nb_orders_total'), 2)}, 0e0) as avg_basket_ht
  from (select customer_key, boutique_id, nb_orders_total, ca_total_ht, coalesce(ca_6m_ht, 0e0) as ca_6m_ht,
    coalesce(ca_6m_n1_ht, 0e0) as ca_6m_n1_ht from sums)""")
q("customer_profile", ["prof"], "select * from prof")
q("customer_detail", ["detail"], "select * from detail")
q("group_identities", ["hipp"], f"select boutique_id, {ID_COLS}, unified_key from hipp")
q("segments", ["detail"], f"select boutique_id, segment, churn_color, presence, count(*) as n, {es('ca_total_ht')} as ca from detail group by 1, 2, 3, 4")
q("merged_customers", ["hipp"], "select * from hipp")
q("overdue_customers", ["owed"], "select * from owed")
q("overdue_list", ["owed"], "select * exclude (boutique_id) from owed where boutique_id in ('HPC', 'ACC')")
q("overdue_totals", ["owed"], f"select coalesce({es('total_overdue_ht')}, 0e0) as total_overdue_ht, count(*) as nb_clients from owed where boutique_id in {ALL}")
LISTED = "customer_id, customer_name, boutique_id, dept_code, city, churn_color, segment, ca_total_ht, ca_12m_ht, last_order_date, recency_days"
q("customer_list", ["prof"], f"select {LISTED}, cast(null as string) as presence from prof where boutique_id in ('HPC', 'SED')")
q("customer_list_all", ["hipp"], f"select {LISTED}, presence from hipp")
q("customer_search", ["cust0"], f"""select id as customer_id, name from cust0 where boutique_id in {ALL} and (name ilike '%maison%' or id ilike '%maison%')
  order by name, boutique_id, id""")
FILE = f"(select * from detail where customer_id = '24' and boutique_id in ('HIPP', 'SED', 'HIP') order by boutique_id <> 'HIPP', boutique_id, customer_key limit 1)"
q("customer_file", ["detail"], f"select * from {FILE}")
q("customer_file_sources", ["detail"], f"""select boutique_id, customer_key, customer_id, customer_name, address1, address2, zip_code, city, country_iso_code,
  email, phone, ca_total_ht, ca_12m_ht, last_order_date from detail where boutique_id in {ALL} and unified_key = (select unified_key from {FILE})""")
MONTHLY = f"select date_trunc('month', document_date)::date as month, {es('amount_ht')} as ca_ht from docs where is_valid_sale and customer_key in (from grp)"
q("customer_monthly", ["docs", "grp"], f"{MONTHLY} and document_date >= {back(12)} group by 1")
q("customer_history", ["docs", "grp"], f"{MONTHLY} group by 1")
q("customer_top_items", ["top5", "grp"], f"""select row_number() over (order by {es('total_qty_12m')} desc, item_id) as rank, item_id,
  min(item_caption) as item_caption, {es('total_qty_12m')} as total_qty_12m, cast(sum(order_count_item) as bigint) as order_count_item
  from top5 where customer_key in (from grp) group by item_id order by rank limit 5""")
q("customer_last_orders", ["docs", "lines", "grp"], """select document_date, amount_ht, document_number,
  (select count(distinct item_id) from lines l where l.document_id = d.id and l.boutique_id = d.boutique_id) as nb_refs
  from (select * from docs where is_valid_sale and customer_key in (from grp) order by document_date desc, boutique_id, id desc limit 10) d""")
OPEN = f"""select document_number, document_date, amount_ttc, balance_due, greatest(amount_ttc - balance_due, 0e0) as amount_paid,
  amount_ttc - balance_due > 0 as partial from docs where customer_key in (from grp) and boutique_id in {ALL} and document_type = 2 and balance_due > 0"""
q("unpaid_invoices", ["docs", "grp"], OPEN)
q("unpaid_totals", ["docs", "grp"], f"select {es('balance_due')} as total_overdue_ht, nullif(count(*), 0) as nb_invoices_overdue from ({OPEN})")

q("revenue_by_dept", ["bydept"], "select * from bydept")
q("revenue_by_country", ["bycountry"], "select * from bycountry")
q("customers_by_dept", ["prof0"], f"""select customer_key, boutique_id, customer_id, customer_name, city, dept_code, ca_total_ht, ca_12m_ht,
  case when known then last_order_date end as last_order_date, case when known then recency_days end as recency_days, churn_alert, reorder_status,
  {traffic('known')} as churn_color from prof0 where dept_code is not null and is_france""")
q("geo_france", ["docs", "fcust", "seed"], geo_france(ALL, "document_date between date '1999-02-01' and date '2001-05-31'"))
q("geo_countries", ["docs", "cust0"], f"""select g.*, coalesce(i3, country_iso_code) as country_iso3, coalesce(nm, country_iso_code) as country_name
  from ({geo_countries(ALL, f"document_date >= {back(24)}")}) g left join (values {COUNTRY_VALUES}) as t(i2, i3, nm) on i2 = country_iso_code""")
q("geo_countries_12m", ["docs", "cust0"], geo_countries("('HIP', 'HPC', 'ACC')", f"document_date >= {back(12)}"))
q("geo_country_customers", ["docs", "cust"], "select * exclude (nb_orders) from (" + place_customers(
    "country_iso_code = 'ES'", ALL, "c.unified_key", "true") + ")")
q("geo_dept_customers", ["docs", "cust"], place_customers(
    f"dept_code = '20' and country_iso_code in {FR}", "('HIP', 'SED', 'HPC', 'ACC')", "c.customer_key", f"document_date >= {back(36)}"))
q("top_departments", ["bydept"], "select * from bydept where boutique_id = 'HIP' and is_metro order by revenue_ht_12m desc, dept_code limit 10")
q("top_countries", ["bycountry"], "select * from bycountry where not is_france_group order by ca_12m_ht desc, country_iso_code, boutique_id limit 20")
EVERY = "('HIP', 'SED', 'HPC', 'ACC')"
q("geo_totals", ["docs", "fcust", "seed"], f"""select {es('revenue_ht')} as total_ca, cast(sum(active_customers) as bigint) as total_clients,
  cast(sum(order_count) as bigint) as total_orders, {hu(rat(es('revenue_ht'), 'sum(order_count)'), 2)} as avg_basket, greatest(max(revenue_ht), 1e0) as max_ca
  from ({geo_france(EVERY, f"document_date >= {back(12)}")})""")
q("country_totals", ["docs", "cust0"], f"""select {es('ca_ht')} as total_ca, count(*) as active_countries, cast(sum(nb_customers_actifs) as bigint) as active_clients
  from ({geo_countries(EVERY, f"document_date >= {back(36)}")})""")
q("map_fill", ["docs", "fcust", "seed"], f"""select s.dept_code, s.dept_name, revenue_ht, coalesce(active_customers, 0) as active_customers,
  coalesce(order_count, 0) as order_count from seed s left join ({geo_france("('HPC')", f"document_date >= {back(12)}")}) g on g.dept_code = s.dept_code""")
q("customers_bbox", ["cust0", "rfm"], """select customer_key, name as customer_name, latitude, longitude, c.boutique_id, monetary_12m
  from cust0 c join rfm using (customer_key) where latitude between 41e0 and 51.5e0 and longitude between -5.5e0 and 10e0""")
q("zip_quality", ["cust0"], """select count(*) as total, count(*) filter (zip_code is null or length(trim(zip_code)) < 4) as no_zip,
  count(*) filter (length(trim(zip_code)) in (1, 2, 3)) as malformed from cust0""")

q("season_label", ["docs"], f"""select {season('document_date')} as season_label, min(document_date) as first_day, max(document_date) as last_day,
  count(*) as n from docs group by 1""")
q("item_season_perf", ["perf"], "select * from perf")
q("item_catalog", ["catalog"], "select * from catalog")
q("top_customers_per_item", ["besties"], "select * from besties")
q("top_items_per_customer", ["top5"], "select * from top5")
CAT = ("item_id, item_caption, type_vetement, qty_sold_season, ca_season_ht, margin_ht_season, margin_rate, ca_trend_season_pct,"
       " ca_prev_season_ht, nb_clients_season, current_stock, sell_through_pct, season_label")
q("catalog_list", ["catalog"], f"""select {CAT} from catalog where boutique_id = 'HPC' and type_vetement = 'ROBE' and item_caption ilike '%ring%'
  order by margin_rate desc nulls last, item_id""")
q("catalog_multi_shop", ["catalog"], f"""select {CAT} from (select *, {rat('margin_ht_season', 'ca_season_ht')} * 100e0 as margin_rate,
    {rat('ca_season_ht - ca_prev_season_ht', 'ca_prev_season_ht')} * 100e0 as ca_trend_season_pct,
    {rat('qty_sold_season', 'qty_sold_season + coalesce(current_stock, 0e0)')} * 100e0 as sell_through_pct
  from (select item_id, arg_min(item_caption, boutique_id) as item_caption, arg_min(type_vetement, boutique_id) as type_vetement,
    any_value(season_label) as season_label, {es('qty_sold_season')} as qty_sold_season, {es('ca_season_ht')} as ca_season_ht,
    {es('margin_ht_season')} as margin_ht_season, {es('ca_prev_season_ht')} as ca_prev_season_ht, {es('current_stock')} as current_stock,
    cast(sum(nb_clients_season) as bigint) as nb_clients_season from catalog where boutique_id in {ALL} group by 1))
  order by sell_through_pct desc nulls last, item_id""")
q("catalog_types", ["catalog"], f"select distinct type_vetement from catalog where boutique_id in {ALL}")
q("item_customers", ["besties"], """select customer_key, customer_id, customer_name, total_qty, total_ca_ht, nb_orders, last_order_date, rank
  from besties where item_id = '7'""")
q("seasons", ["perf"], f"select season_label, bool_or(is_current_season) as is_current from perf where boutique_id in {ALL} group by 1")
q("default_season", ["perf"], f"""select season_label, is_current_season as is_current from perf where boutique_id in {ALL}
  order by is_current_season, season_label desc limit 1""")
SEASONED = ("item_id, item_caption, coalesce(type_vetement, 'Autres') as type_vetement, qty_sold_season, revenue_ht_season, margin_ht_season, margin_rate,"
            " real_stock_current, is_current_season, revenue_ht_season_n1, ca_trend_season_pct")
q("season_items", ["lastsale"], f"select {SEASONED} from lastsale where boutique_id = 'HIP'")
q("season_types", ["lastsale"], f"select distinct coalesce(type_vetement, 'Autres') as type_vetement from lastsale where boutique_id in {ALL}")
q("best_and_flops", ["lastsale"], f"""with s as (select {SEASONED}, row_number() over (order by revenue_ht_season desc, item_id) as b
    from lastsale where boutique_id = 'SED'),
  f as (select *, row_number() over (order by revenue_ht_season, item_id) as w from s where b > 10 and real_stock_current > 0)
  select 'best' as mode, b as rank, * exclude (b) from s where b <= 10 union all select 'flop', w, * exclude (b, w) from f where w <= 10""")

q("stock_status", ["stat"], "select * from stat")
q("stock_list", ["stat"], f"""select item_id, coalesce(item_caption, '(ID: ' || item_id || ')') as item_caption, storehouse_id,
  coalesce(storehouse_name, storehouse_id) as storehouse_name, real_stock, stock_value, coverage_days, urgency_rank,
  coalesce(is_rupture, false) as is_rupture, coalesce(is_surstock, false) as is_surstock, coalesce(is_dormant, false) as is_dormant
  from stat where boutique_id in {ALL}""")
q("stock_counts", ["stat"], f"""select count(*) filter (urgency_rank = 0) as n_rupture, count(*) filter (urgency_rank = 1) as n_surstock,
  count(*) filter (urgency_rank = 2) as n_dormant from stat where boutique_id in {ALL}""")
q("storehouse_choices", ["stat"], f"""select storehouse_id, coalesce(min(storehouse_name), storehouse_id) as label from stat
  where boutique_id in {ALL} group by storehouse_id""")
q("stockouts", ["stock", "items", "stores", "lines", "docs"], f"""select k.item_id, i.caption as item_caption, type_vetement, storehouse_id,
    s.caption as storehouse_name from stock k join items i on i.id = k.item_id and i.boutique_id = k.boutique_id
  join stores s on s.id = k.storehouse_id and s.boutique_id = k.boutique_id
  where k.real_stock <= 0 and active_state = 1 and exists (select 1 from lines l join docs d on d.id = l.document_id and d.boutique_id = l.boutique_id
    where l.item_id = k.item_id and l.boutique_id = k.boutique_id and is_valid_sale and document_date >= {D} - 90)
  order by i.caption, k.boutique_id, k.item_id, k.storehouse_id""")

VALID = "document_type = 2 and is_valid_sale"
ORDERS = "count(distinct boutique_id || '/' || id)"
DAILY = f"""select document_date as date, {hu(es('amount_ht'), 2)} as ca, {ORDERS} as nb_orders from docs
  where boutique_id in {ALL} and {VALID} and document_date between {D} - 365 and {D} group by 1"""
q("revenue_per_day", ["docs"], f"select *, dayofweek(date) in (0, 6) as is_weekend from ({DAILY})")
q("revenue_per_day_filled", ["docs"], f"""select day::date as date, coalesce(ca, 0e0) as ca, coalesce(nb_orders, 0) as nb_orders
  from (select unnest(generate_series({D} - 30, {D}, interval 1 day)) as day)
  left join (select document_date, {hu(es('amount_ht'), 2)} as ca, {ORDERS} as nb_orders from docs where boutique_id = 'ACC' and {VALID} group by 1)
    on document_date = day::date""")
q("revenue_per_month", ["docs"], f"""select strftime(document_date, '%Y-%m') as mois, {hu(es('amount_ht'), 2)} as ca, {ORDERS} as nb_orders,
  count(distinct customer_key) as nb_clients from docs where {VALID} and document_date between {D} - 730 and {D} group by 1""")
q("revenue_per_weekday", ["docs"], f"""select cast(dayofweek(document_date) + 1 as bigint) as dow,
  case dayofweek(document_date) when 0 then 'Dim' when 1 then 'Lun' when 2 then 'Mar' when 3 then 'Mer' when 4 then 'Jeu' when 5 then 'Ven' else 'Sam' end as label,
  {hu(rat(es('amount_ht'), 'count(distinct document_date)'), 2)} as avg_ca, {hu(es('amount_ht'), 2)} as total_ca,
  count(distinct document_date) as nb_jours, count(*) as nb_orders
  from docs where boutique_id = 'SED' and {VALID} and document_date between {D} - 730 and {D} group by 1, 2""")


def top_clients(shops, group):
    return f"""select min(name) as customer_name, min(c.id) as customer_id, {hu(es('amount_ht'), 2)} as ca, count(distinct d.boutique_id || d.id) as nb_orders,
      {hu(rat(es('amount_ht'), 'count(distinct d.boutique_id || d.id)'), 2)} as panier_moyen
    from docs d join cust0 c on c.customer_key = d.customer_key where d.boutique_id in {shops} and {VALID} and document_date between {D} - 730 and {D}
    group by {group} order by {es('amount_ht')} desc, {group} limit 10"""


q("top_customers", ["docs", "cust0"], top_clients(EVERY, "c.name"))
q("top_customers_by_key", ["docs", "cust0"], top_clients("('HIP')", "c.customer_key"))
q("revenue_per_month_all", ["docs"], f"""select date_trunc('month', document_date)::date as month, {es('amount_ht')} as ca_ht from docs
  where is_valid_sale and document_date >= {back(12)} group by 1""")
q("range_summary", ["docs"], f"""select {hu(es('ca'), 2)} as total_ca, cast(sum(nb_orders) as bigint) as total_orders,
  {hu(rat(es('ca'), 'sum(nb_orders)'), 2)} as avg_basket, first(date order by ca desc, date) as best_day, max(ca) as best_day_ca from ({DAILY})""")

q("range_totals_any", ["docs"], " union all ".join(
    f"""select '{name}' as range_name, coalesce({hu(es('amount_ht'), 2)}, 0e0) as ca, {ORDERS} as nb_orders,
      coalesce({hu(rat(es('amount_ht'), ORDERS), 2)}, 0e0) as avg_basket from docs
      where boutique_id in {ALL} and {VALID} and document_date between date '{start}' and date '{end}'"""
    for name, (start, end) in {"year": ("2000-08-01", "2001-08-01"), "quarter": ("2001-01-01", "2001-03-31"),
                               "one_day": ("2000-06-15", "2000-06-15"), "no_sales": ("1980-01-01", "1980-12-31")}.items()))

q("freshness", ["docs"], """select max(document_date) as last_doc_date, cast(date '2001-08-20' - max(document_date) as bigint) as days_ago,
  'orange' as level from docs where document_type = 2""")
q("monitoring_summary", ["churn", "stat", "rfm"], f"""select * from
  (select count(*) filter (churn_level = 'critique') as critique, count(*) filter (churn_level = 'modere') as modere,
     count(*) filter (churn_level = 'surveillance') as surveillance from churn where boutique_id in {ALL}),
  (select count(*) filter (urgency_rank = 0) as rupture, count(*) filter (urgency_rank = 1) as surstock, count(*) filter (urgency_rank = 2) as dormant
     from stat where boutique_id in {ALL}),
  (select count(*) filter (reorder_status = 'en_retard') as en_retard, count(*) filter (reorder_status = 'du_semaine') as du_semaine
     from rfm where boutique_id in {ALL})""")
q("kpis", ["docs", "cust0", "stat", "rfm"], f"""select ca_12m, ca_12m_precedents, {pct('ca_12m - ca_12m_precedents', 'ca_12m_precedents')} as ca_trend_pct,
    clients_actifs_12m, clients_total, nb_orders_12m, {hu(rat('ca_12m', 'nb_orders_12m'), 2)} as panier_moyen, total_articles,
    {pct('normal', 'total_articles')} as pct_normal, {pct('alert', 'total_articles')} as pct_alerte, {pct('enough', 'n')} as pct_clients_suffisant,
    {pct('covered', 'total_articles')} as pct_articles_coverage_calculable
  from (select {es('amount_ht')} as ca_12m, count(distinct customer_key) as clients_actifs_12m, {ORDERS} as nb_orders_12m from docs
      where boutique_id in {ALL} and document_type = 2 and document_date >= {D} - 365),
    (select {es('amount_ht')} as ca_12m_precedents from docs where boutique_id in {ALL} and document_type = 2
      and document_date >= {D} - 730 and document_date < {D} - 365),
    (select count(distinct customer_key) as clients_total from cust0 where boutique_id in {ALL}),
    (select count(*) as total_articles, count(*) filter (urgency_rank = 3) as normal, count(*) filter (urgency_rank < 3) as alert,
      count(*) filter (coverage_days > 0) as covered from stat where boutique_id in {ALL}),
    (select count(*) as n, count(*) filter (reorder_status <> 'insuffisant') as enough from rfm where boutique_id in {ALL})""")
LASTDAY = "(select max(document_date) from docs where is_valid_sale)"
q("daily_orders", ["docs", "cust0", "lines"], f"""select document_number, document_date, amount_ht, customer_id, name as customer_name,
    (select count(*) from lines l where l.document_id = d.id and l.boutique_id = d.boutique_id) as nb_refs
  from docs d join cust0 c on c.customer_key = d.customer_key where is_valid_sale and document_date = {LASTDAY}
  order by amount_ht desc, d.boutique_id, d.id""")
q("daily_totals", ["docs"], f"""select max(document_date) as reference_date, {ORDERS} as nb_orders, {es('amount_ht')} as ca_ht from docs
  where is_valid_sale and document_date = {LASTDAY}""")
q("new_customers", ["docs", "cust0", "sums"], f"""select c.id as customer_id, name as customer_name, first_invoice_date, city, ca_total_ht
  from cust0 c join sums s on s.customer_key = c.customer_key where first_invoice_date between {LASTDAY} - 30 and {LASTDAY}
  order by first_invoice_date desc, c.customer_key""")

q("prospects", ["mart"], f"select {MART_OUT} from mart")
q("prospect_match", ["matched"], "select * from matched")
q("keyword_tags", ["reg"], f"select siret, array_to_string({tags('denomination')}, ',') as tags from reg")
q("chain_flag", ["reg"], f"""select row_id, regexp_matches(upper(coalesce(t, '')), '{CHAINS_SQL}') as is_chain
  from (select siret as row_id, denomination as t from reg union all select cast(page_id as string), html from pages)""")
q("prospect_score", ["scored"], """select siret, score_prospect, case when score_prospect >= 80 then 'fort' when score_prospect >= 60 then 'bon'
  when score_prospect >= 40 then 'moyen' else 'faible' end as band from scored""")
q("prospects_by_dept", ["pbd"], "select * from pbd")
SUMS4 = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("nb_sirene_total", "nb_clients", "nb_prospects_nets", "nb_matches_incertains"))
q("prospect_totals", ["pbd"], f"select {SUMS4}, {pct('sum(nb_clients)', 'sum(nb_sirene_total)')} as taux_penetration_pct from pbd")
q("uncertain_matches", ["mart", "hipp"], """select siret, denomination, m.zip_code, m.city, m.dept_code, matched_unified_key,
  h.customer_name as matched_client_name, h.zip_code as matched_client_zip, 1e0 as similarity_score
  from mart m left join hipp h on h.customer_key = matched_unified_key where match_rule = 'M3_NOM_CP'""")
q("prospect_search", ["found", "seed"], f"""select {MART_OUT} from found
  where statut in ('a_contacter', 'contacte') and (lower(denomination) like '%e%' or siret like '%e%' or lower(city) like '%e%')
    and dept_code in (select dept_code from seed where region_name in ('Occitanie', 'Bretagne', 'Grand Est', 'Normandie'))
    and (list_has_any(tag_list, ['femme', 'luxe']) or len(tag_list) = 0) and score_prospect >= 20 and date_creation >= date '1991-01-01'""")
q("prospect_page", ["found"], f"""select {MART_OUT}, (select count(*) from found) as _total,
  (select count(*) from found where statut = 'a_contacter') as _nb_a_contacter, (select count(*) from found where statut = 'contacte') as _nb_contacte,
  (select count(*) from found where statut = 'pas_interesse') as _nb_pas_interesse
  from found order by score_prospect desc nulls last, denomination asc nulls first, siret limit 25 offset 10""")
q("headcount_options", ["mart"], """select distinct tranche_effectif_code as code, tranche_effectif_libelle as label from mart
  where is_prospect and tranche_effectif_code is not null""")
q("prospect_options", ["mart", "seed"], """select distinct 'headcount' as kind, tranche_effectif_code as code, tranche_effectif_libelle as label
  from mart where is_prospect and tranche_effectif_code is not null union all select distinct 'region', region_name, region_name from seed""")
q("upsert_status", ["judged", "status"], f"""with latest as (select siret, statut, note,
    case when statut = 'a_contacter' then dernier_contact else coalesce(dernier_contact, {D}) end as dernier_contact, updated_at
    from judged where reason is null qualify row_number() over (partition by siret order by updated_at desc) = 1)
  select *, cast(null as string) as updated_by from (select siret, statut, note, dernier_contact, updated_at from latest
    union all select siret, statut, note, dernier_contact, updated_at from status where siret not in (select siret from latest))""")
q("upsert_rejects", ["judged"], "select siret, statut, updated_at, reason from judged where reason is not null")

q("threshold_filter", ["catalog"], """select * from catalog where qty_sold_season >= 10 and coalesce(ca_season_ht, 0) >= 1000 and margin_rate >= 35
  and ca_trend_season_pct >= -50 and coalesce(current_stock, 0) <= 80 and item_caption ilike '%ring%'""")
q("sort_nulls_last", ["cust0"], "select customer_key, longitude, city from cust0 order by longitude desc nulls last, customer_key limit 40 offset 80")
q("sort_natural", ["cust0"], """select city, count(*) as n, 'ville ' || lpad(cast(length(ltrim(substr(city, 7), '0')) as varchar), 10, '0') || ltrim(substr(city, 7), '0') as sort_key from cust0
  where city is not null group by 1""")
q("filter_choices", ["cust0"], "select distinct dept_code from cust0 where dept_code <> ''")
q("quintile_buckets", ["pbd"], """with p as (select nb_prospects_nets as x, row_number() over (order by nb_prospects_nets, code_departement) - 1 as i,
    count(*) over () as n from pbd where nb_prospects_nets > 0 and code_departement not like '97%'),
  c as (select max(x) filter (i = least(n - 1, n * 1 // 5)) as c1, max(x) filter (i = least(n - 1, n * 2 // 5)) as c2,
    max(x) filter (i = least(n - 1, n * 3 // 5)) as c3, max(x) filter (i = least(n - 1, n * 4 // 5)) as c4 from p)
  select code_departement, nb_prospects_nets, cast(case when nb_prospects_nets <= 0 then null when nb_prospects_nets <= c1 then 1
    when nb_prospects_nets <= c2 then 2 when nb_prospects_nets <= c3 then 3 when nb_prospects_nets <= c4 then 4 else 5 end as bigint) as bucket
  from pbd, c""")
q("min_max_scale", ["docs"], """select id, amount_ht, 4e0 + coalesce((amount_ht - min(amount_ht) over ())
  / (max(amount_ht) over () - min(amount_ht) over ()), 0e0) * 16e0 as size from docs""")
q("share_of_max", ["docs", "grp"], f"select *, ca_ht / max(ca_ht) over () as share from ({MONTHLY} group by 1)")
q("band", ["docs"], f"""select customer_key, case when age < 30 then 'vert' when age <= 90 then 'amber' else 'rouge' end as freshness,
    case when (ca - 1000000e0) / 10000e0 > 5 then 'hausse' when (ca - 1000000e0) / 10000e0 < -5 then 'baisse' else 'stable' end as trend,
    case when ca / 50000e0 >= 70 then 'bon' when ca / 50000e0 >= 50 then 'moyen' else 'faible' end as quality,
    case when ca / 60000e0 >= 70 then 'bon' when ca / 60000e0 >= 40 then 'moyen' else 'faible' end as sell_through
  from (select customer_key, {D} - max(document_date) as age, {es('amount_ht')} as ca from docs group by 1)""")


q("revenue_per_month_all_time", ["docs"], f"""select strftime(document_date, '%Y-%m') as mois, {hu(es('amount_ht'), 2)} as ca, {ORDERS} as nb_orders,
  count(distinct customer_key) as nb_clients from docs where {VALID} and boutique_id in {ALL} and document_date <= {D} group by 1""")
q("quantile_many_groups", [], f"""select c_mktsegment as segment, strftime(o_orderdate, '%Y-%m') as month, {hu('quantile_cont(o_totalprice, 0.9)', 4)} as p90
  from orders join customer on o_custkey = c_custkey group by 1, 2""")
q("natural_key_long", [], """select cast(p_partkey as varchar) as row_id,
  'x' || lpad(cast(length(ltrim(d, '0')) as varchar), 10, '0') || ltrim(d, '0') as sort_key
  from (select p_partkey, repeat('0', cast(p_size as bigint)) || repeat(cast(p_partkey as varchar), 6) as d from part)""")
q("exact_sum_plain_decimal", [], """select o_orderstatus, cast(sum(cast(o_totalprice as decimal(18, 4))) as double) as total from orders group by 1""")
q("raw_csv_round_trip", ["cust"], "select * from cust")
q("raw_csv_line_breaks", ["cust0"], """select * replace (case when cast(id as bigint) % 3 = 0
    then name || chr(10) || chr(10) || 'ligne "2"; fin' else name end as name) from cust0""")
q("prospect_search_all_filters", ["mart", "status"], f"""select {MART_OUT} from (select siret, siren, denomination, adresse_voie, adresse_complement, zip_code, city,
    dept_code, date_creation, tranche_effectif_code, tranche_effectif_libelle, etat_admin, categorie_juridique, forme_juridique, score_prospect, is_chain, tag_list,
    coalesce(statut, 'a_contacter') as statut, note, dernier_contact, updated_at from mart left join status using (siret)
  where is_prospect and dept_code = '75' and tranche_effectif_code in ('NN', '00', '01', '11') and zip_code like '7%' and date_creation <= date '2000-01-01'
    and forme_juridique in ('societe', 'ei', 'autre'))""")
q("country_fix", [], """select n_name, case n_nationkey % 4 when 0 then 'CI' when 1 then 'IL' when 2 then 'CO' else upper(left(n_name, 2)) end as country from nation""")
q("active_flag", [], """select p_partkey, case p_partkey % 5 when 0 then true when 1 then true else false end as active from part""")
q("shared_referential", ["cust0"], "select customer_key, boutique_id in ('HIP', 'SED', 'HPC') as shared from cust0")
q("stock_list_filtered", ["stat"], Q["stock_list"][1] + " and storehouse_id = '1' and urgency_rank = 1")
q("country_labels_all", [], "select n_name, left(n_name, 2) as country_iso_code, true as has_name, true as has_code from nation")
q("foreign_countries", ["cust0"], """select country_iso_code, count(*) as n, case country_iso_code when 'ES' then 'Espagne' else 'Belgique' end as country_name,
  case country_iso_code when 'ES' then 'ESP' else 'BEL' end as iso3 from cust0 where country_iso_code in ('ES', 'BE') group by 1""")
q("map_fill_countries", ["cust0"], "select a.iso2, a.iso3, a.country_name, coalesce(n, 0) as n from (values "
  + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in fixed.COUNTRIES)
  + ") a(iso2, iso3, country_name) left join (select country_iso_code, count(*) as n from cust0 group by 1) f on f.country_iso_code = a.iso2")
q("page_after", ["cust0"], """select customer_key, longitude, city from cust0
  where longitude is null or longitude < 9e0 or (longitude = 9e0 and customer_key > 'HIP|1') order by longitude desc nulls last, customer_key limit 30""")
q("row_counts", ["docs"], "select 'checked_documents' as table_name, true as exists, (select count(*) from docs) as row_count union all select 'no_such_table', false, null")
q("seed_reader", [], "select cast(n_nationkey as varchar) as n_nationkey, n_name from nation")
q("vip_threshold_approx", ["docs"], "select boutique_id, true as found from docs where is_valid_sale group by 1")
q("upsert_ties", [], """select siret, 'contacte' as statut, 'vu' as note, date '2001-01-01' + cast(k % 4 as int) as dernier_contact,
    timestamp '2001-07-02 08:00:00' as updated_at, who as updated_by
  from (select lpad(cast(c_custkey - c_custkey % 4 as varchar), 14, '0') as siret, c_custkey as k, c_name as who from customer) e
  qualify row_number() over (partition by siret order by k % 4 desc) = 1""")


def _ordered(names, seen=None):
    """Needed CTEs, each after those it reads."""
    out = []
    seen = set() if seen is None else seen
    for name in names:
        if name in seen:
            continue
        needs, _ = CTES[name]
        out += _ordered(needs, seen)
        if name not in seen:
            seen.add(name)
            out.append(name)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (needs, sql) in Q.items():
        parts = [f"{n} as ({CTES[n][1]})" for n in _ordered(needs)]
        body = sql.strip()
        if parts and body.lower().startswith("with "):
            body = ", " + body[5:]
            out[name] = "with " + ", ".join(parts) + body
        else:
            out[name] = ("with " + ", ".join(parts) + " " if parts else "") + body
    return out
