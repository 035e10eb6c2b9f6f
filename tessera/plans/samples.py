"""Small source files that the code queries read; there are none among the tables."""

ORDER_SERVICE = '''package shop.orders;

import java.util.List;
import shop.model.Invoice;
import shop.model.Order;

/**
 * Takes orders and writes an invoice for each of them.
 */
@Component
public class OrderService extends BaseService implements OrderApi, ChangeListener {
    private final OrderDao dao;
    private List<Order> open, done;
    static final String TEXT = "braces } in { text; // no comment";

    public OrderService(OrderDao dao) {
        this.dao = dao;
    }

    /** Processes an order and stores the invoice that belongs to it. */
    @Override
    public Invoice processOrder(Order order, int amount) throws OrderError {
        if (order == null) {
            throw new OrderError("no } order");
        }
        Invoice invoice = new Invoice(order, amount);
        dao.save(invoice); // }
        return invoice;
    }

    public Order getOrder(long id) {
        return dao.find(id);
    }

    protected abstract void close();

    /** States of an order. */
    public enum State {
        NEW("n") { boolean isOpen() { return true; } },
        DONE("d");

        private final String code;

        State(String code) {
            this.code = code;
        }

        boolean isOpen() {
            return false;
        }
    }

    private static class Entry {
        Order order;
        State state;
    }
}
'''

ORDER_DAO = """package shop.orders;

import shop.model.*;

public class OrderDao {
    private static OrderDao instance;

    public static OrderDao getInstance() {
        if (instance == null) {
            instance = new OrderDao();
        }
        return instance;
    }

    public void save(Invoice invoice) {
        int[] sizes = {1, 2, 3};
        for (int s : sizes) {
            System.out.println(s + invoice.toString() + "saved to the table of invoices");
        }
    }

    public Order find(long id) { return null; }
}
"""

MODEL = """package shop.model;

public class Invoice {
    public Order order;
    public int amount;
    int a = 1, b = 2;
}

interface Priced extends Comparable<Priced> {
    double price(Currency currency, int digits);
}
"""

TOOL_PY = '''"""A tool."""

import sys


class Reader:
    """Reads."""

    def lines(self):

        return sys.stdin


def main(argv):
    for line in Reader().lines():
        print(line)
    return 0


main(sys.argv)
'''

CLIENT_TS = """/** A client. */
export interface Options {
  url: string;
}

export class Client {
  constructor(private o: Options) {
  }
}

export async function fetchAll(o: Options) {
  const c = new Client(o);
  return c;
}
type Id = string;
"""

POOL_GO = """package pool

type Pool struct {
	size int
}

func (p *Pool) Get(n int) int {
	if n > 0 {
		return n
	}
	return p.size
}
"""

JAVA = [("java/shop/OrderService.java", ORDER_SERVICE), ("java/shop/OrderDao.java", ORDER_DAO), ("java/shop/Model.java", MODEL)]
OTHER = [("tools/tool.py", TOOL_PY, "python"), ("web/client.ts", CLIENT_TS, "typescript"), ("pool/pool.go", POOL_GO, "go")]
TEMPLATES = [
    ("templates/OrderService.json", '{"OrderService": {"use": "OrderDao", "n": 1}, "Invoice": ["Order"]}'), ("templates/page.json", '{"title": "Invoice", "body": {"Priced": "x"}}'),
    ("templates/list.json", '{"items": ["Invoice", "OrderDao"]}'), ("templates/broken.json", '{"Invoice": '),
]
MARKDOWN = [("docs/guide.md", "Intro line\n\n# First\nabout orders\n\n## Second part\n- a\n- b\n"), ("docs/short.md", "# Only\ntext")]
