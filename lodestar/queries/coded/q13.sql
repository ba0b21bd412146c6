SELECT sum(lo_extendedprice * lo_discount) AS revenue
FROM lineorder
WHERE lo_orderdate BETWEEN 19970204 AND 19970210
  AND lo_discount BETWEEN 5 AND 7
  AND lo_quantity BETWEEN 26 AND 35
