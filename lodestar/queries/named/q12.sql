SELECT sum(lo_extendedprice * lo_discount) AS revenue
FROM lineorder, ddate
WHERE lo_orderdate = d_datekey
  AND d_yearmonthnum = 199701
  AND lo_discount BETWEEN 4 AND 6
  AND lo_quantity BETWEEN 26 AND 35
