SELECT sum(lo_extendedprice * lo_discount) AS revenue
FROM lineorder
WHERE lo_orderdate BETWEEN 19960101 AND 19970101
  AND lo_discount BETWEEN 1 AND 3
  AND lo_quantity < 25
