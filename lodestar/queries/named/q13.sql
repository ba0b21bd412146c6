SELECT sum(lo_extendedprice * lo_discount) AS revenue
FROM lineorder, ddate
WHERE lo_orderdate = d_datekey
  AND d_weeknuminyear = 6
  AND d_year = 1997
  AND lo_discount BETWEEN 5 AND 7
  AND lo_quantity BETWEEN 26 AND 35
